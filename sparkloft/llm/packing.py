"""Sum-of-squares packing of token sequences.

Each task reads its share of the documents, tokenises them and packs the pieces on the spot: a piece goes where the sum
over residual gaps of the squared number of open bins becomes smallest (a new bin counts like any other place). Token ids
never cross a shuffle on the way. Pieces are placed in rounds of at most ROUND tokens (more only if one document has more), long
ones first; bins stay open from round to round until they hold OPEN tokens in all, which are then left to the last step. So
a task holds at most a round and OPEN tokens, whatever its share of the documents.

What a task leaves in bins that are not full is a small rest. The lengths of its pieces alone are brought together, a
bounded number for each group, and packed once more; the new places are joined to the pieces. Only these rows are shuffled.

Defined results: null text counts as empty and makes one piece, the end mark. Repeated rows are packed each; ids may be null or
repeated, as places are told apart by sequence and offset. Of very long texts every piece but the first is full. Equally good
places: the smallest gap. An empty table gives no piece. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.sources.tables import fresh_dir, table

LENGTH, END = 1024, 2
#: Tokens of a round, and of open bins, that a task holds; pieces of one group of the last step.
ROUND, OPEN, GROUP = 2_000_000, 4_000_000, 40_000


class Bins:
    """Open bins of a size, by gap. `counts[g]` bins have g places left; `stacks[g]` names them."""

    def __init__(self, size: int, made: int = 0):
        self.size, self.made = size, made
        self.counts = np.zeros(size + 1, np.int64)
        self.stacks: dict[int, list[int]] = defaultdict(list)

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece, where the sum of squares grows least; on a tie the smallest gap left."""
        size, counts = self.size, self.counts
        best, gap = 2 * counts[size - length] + 1 if length < size else 0, size
        if self.stacks:
            gaps = counts[length:size]
            after = counts[: size - length].copy()
            after[:1] = 0
            grows = 2 * (after - gaps) + 2
            grows[:1] -= 1  # a full bin is no longer counted
            grows[gaps == 0] = np.iinfo(np.int64).max
            k = int(np.argmin(grows)) if len(grows) else 0
            if len(grows) and grows[k] <= best:
                gap = length + k
        if gap == size:
            name, self.made = self.made, self.made + 1
        else:
            name = self.stacks[gap].pop()
            counts[gap] -= 1
        left = gap - length
        if left:
            self.stacks[left].append(name)
            counts[left] += 1
        return name, size - gap

    def open_bins(self) -> set[int]:
        return {name for names in self.stacks.values() for name in names}


def repack(lengths: np.ndarray, size: int, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, long ones first. What a round leaves in bins that are not full, the next one packs
    again, among fewer pieces."""
    names, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    todo, made = np.arange(len(lengths)), 0
    for last in [False] * (rounds - 1) + [True]:
        bins = Bins(size)
        for k in todo:
            names[k], offsets[k] = bins.place(int(lengths[k]))
        loose = np.isin(names[todo], [] if last else list(bins.open_bins()))
        names[todo] += made
        made += bins.made
        todo = todo[loose]
    return names, offsets


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document of n tokens; the first may be short."""
    first = n % size or size
    return [(0, min(first, n)), *((at, size) for at in range(first, n, size))]


def encoder(path: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Encodes with the tokenizer file. Where `ranks` names the same vocabulary as ranks, texts of Latin letters go
    through the rank library, which gives the same ids in a quarter of the time; others, and those with the end mark in
    words, through the tokenizer itself."""
    tokenizer = None

    def full(text: str) -> list[int]:
        nonlocal tokenizer
        if tokenizer is None:  # loaded where a text needs it: it takes memory
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
        return tokenizer.encode(text, add_special_tokens=False).ids

    if not ranks:
        return full
    import public_tokenizers
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    plain = re.compile(r"[\x09\x0a\x0d\x20-\x7e¡-¬®-ɏ]*")
    return lambda text: fast.encode_ordinary(text) if plain.fullmatch(text) and "<|" not in text else full(text)


PIECES = "doc_id {}, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"


def pack(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, size: int = LENGTH, end: int = END,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit numbers; `token_ids` reads them), sequence_id, offset of every
    piece. Tokenised pieces stay in the shared folder."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = encoder(tokenizer_path, ranks_path), Bins(size)
        base = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        loose: dict[int, list[tuple]] = defaultdict(list)
        tokens = 0

        def rounds(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal bins
            done = []
            for piece in sorted(held, key=lambda p: -p[3]):
                name, offset = bins.place(piece[3])
                loose[name].append((*piece, base + name, offset))
            held.clear()
            still = bins.open_bins()
            leave = last or sum(p[3] for k in still for p in loose[k]) > OPEN
            for name in [k for k in loose if leave or k not in still]:
                done += [(*p, name in still) for p in loose.pop(name)]
            if leave:
                bins = Bins(size, bins.made)
            for at in range(0, len(done), 1000):
                yield batch(done[at : at + 1000], id_type)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(encode(body) + [end], "<u4")
                held += [(key, k, at, n, ids[at : at + n]) for k, (at, n) in enumerate(cut(len(ids), size))]
                tokens += len(ids)
                if tokens >= ROUND:
                    tokens = 0
                    yield from rounds(False)
        if id_type is not None:
            yield from rounds(True)

    packed = rows.mapInArrow(run, PIECES.format(kind))
    path = fresh_dir(spark, "pieces")
    # a writer holds a block in memory; ids have few values but no piece repeats
    options = {"parquet.block.size": 32 << 20, "parquet.enable.dictionary#ids": "false", "compression": "zstd"}
    packed.write.options(**options).parquet(path)
    packed = spark.read.schema(PIECES.format(kind)).parquet(path)
    rest = packed.where("open").drop("open")
    groups = max(1, rest.count() // GROUP)
    part = F.pmod(F.xxhash64("doc_id", "piece", "sequence_id"), F.lit(groups))

    def again(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "was", "at"], ascending=[False, True, True], ignore_index=True)
        names, offsets = repack(b["length"].to_numpy(), size)
        return b[["was", "at"]].assign(sequence_id=(1 << 62) + (int(b["part"].iloc[0]) << 33) + names, offset=offsets)

    lengths = rest.select(F.col("sequence_id").alias("was"), F.col("offset").alias("at"), "length", part.alias("part"))
    places = lengths.groupBy("part").applyInPandas(again, "was long, at long, sequence_id long, offset long")
    rest = rest.withColumnsRenamed({"sequence_id": "was", "offset": "at"}).join(places, ["was", "at"]).drop("was", "at")
    return packed.where("not open").drop("open").unionByName(rest)


def batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
    names = ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "open")
    columns = [list(c) for c in zip(*rows)]
    columns[4] = [ids.tobytes() for ids in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def token_ids(ids: Column) -> Column:
    """The ids of a piece as an array of numbers."""

    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: np.frombuffer(x, "<u4").astype(np.int32))

    return F.pandas_udf(read, "array<int>")(ids)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32, of their ids as unsigned little-endian 32-bit numbers, in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    pieces = pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return with_digest(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
