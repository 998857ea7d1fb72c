"""WARC archives and their index.

Pages become WARC records, each a gzip member of its own, so a record can be read alone by its offset and size. Members are
gathered to files of about FILE_BYTES (more only if one record has more), which Spark's text writer stores in any file system
that Spark reaches: one row, whose bytes it does not look at, is one file; the zero byte it puts after the row is padding that
gzip readers skip. Equal payloads are stored once, as the response of the largest page id; others revisit it. Reading
takes whole files, whose size is bounded so, and unpacks one member after the other.

Each archive file gives a run of index rows, sorted by URL key and time when it is read. Runs are cut at common bounds (a range
partition by key, time, record and place, so one hot URL is cut too), and in each range of about RANGE_ROWS index rows the
runs' parts are merged by a loser tree that draws on each run in its order: a capture history in one global order over
ranges (`part`) and positions in them (`pos`). Spark only puts a range's rows back into runs, by run and place in the run.

Defined results: null html counts as empty, null url as an empty URL; equal payloads of at least `least_bytes` bytes
are stored once. A null page id is the smallest and stays null; where all pages of a payload lack an id, all are responses.
Repeated page ids are records of their own; of those that share the largest id of a payload each is a response. Line ends in
URLs are left out of the record. Very long pages make a file of their own. Empty tables give empty archives and results. Only
the named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloft.sources.tables import durable, fresh_dir, table

FILE_BYTES, RANGE_ROWS = 16 << 20, 100_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record with the blank lines that end it. A revisit has no block."""
    when = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {when}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(payload)}", "", ""]).encode() + payload + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    found = name.removeprefix("<urn:page:").rstrip(">")
    return int(found) if found else None


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """pages: page_id, url, html. Only ids and digests are shuffled to find equal payloads; the texts once, to meet them."""
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    marked = rows.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size"))
    best = marked.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
    best = durable(best.where("n > 1 and best is not null").select("sha", "best"))
    refers = marked.join(best, "sha").where("page_id is null or page_id != best")
    refers = durable(refers.select(F.col("page_id").alias("p"), F.col("sha").alias("of"), F.col("best").alias("refers_to")).distinct())
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("of"))
    known = rows.withColumn("sha", F.sha1("html")).join(refers, same, "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()

        def file() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary())], names=["value"])
            held.clear()
            return out

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                packed = gzip.compress(record(*row), 6, mtime=0)
                if held and len(held) + len(packed) > file_bytes:
                    yield file()
                held += packed
        if held:
            yield file()

    files = known.select("page_id", "url", F.col("html").cast("binary"), "refers_to").mapInArrow(write, "value binary")
    files.select(F.col("value").cast("string")).write.options(lineSep="\0", maxRecordsPerFile=1).text(path)


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, size and unpacked bytes of each gzip member."""
    at, n = 0, len(content)
    while at < n:
        if not content[at]:
            at += 1
            continue
        unpack, out, here = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if here >= n:
                raise ValueError(f"archive breaks off in the record at {at}")
            part = content[here : here + 16384]
            out.append(unpack.decompress(part))
            here += len(part)
        here -= len(unpack.unused_data)
        yield at, here - at, b"".join(out)
        at = here


def parse(raw: bytes) -> dict:
    """The headers of a record, in lower case, and its `block`."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(out["content-length"])
    if len(rest) != size + 4:
        raise ValueError(f"record {out.get('warc-record-id')} has {len(rest) - 4} bytes, not {size}")
    return out | {"block": rest[:size]}


#: Index rows; at and size are of the compressed member in its file (run), seq is the place in the run.
INDEX = pa.schema([
    ("run", pa.string()), ("seq", pa.int64()), ("urlkey", pa.string()), ("captured_at", pa.timestamp("us", "UTC")), ("page_id", pa.int64()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("at", pa.int64()), ("size", pa.int64()),
])
INDEX_DDL = "run string, seq long, urlkey string, captured_at timestamp, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, at long, size long"


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the path: hosts of one domain stand together."""
    m = re.match(r"(?s).*?://([^/?#]*)(.*)", url)
    return ",".join(reversed(m[1].lower().split(":")[0].split("."))) + ")" + m[2] if m else url


def order_of(urlkey: str, captured_at: datetime, page_id: int | None, run: str, at: int) -> tuple:
    return urlkey, captured_at, page_id is None, page_id or 0, run, at


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all archives below path; those of each file are a run, sorted by key, time and record."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*(c.to_pylist() for c in b.columns)):
                out = []
                for at, size, raw in members(content):
                    r = parse(raw)
                    revisit, mark = r["warc-type"] == "revisit", r["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and digest(r["block"]) != mark:
                        raise ValueError(f"payload of {r['warc-record-id']} is damaged")
                    out.append({
                        "run": name, "urlkey": url_key(r["warc-target-uri"]), "captured_at": datetime.fromisoformat(r["warc-date"].replace("Z", "+00:00")),
                        "page_id": _page(r["warc-record-id"]), "record_type": r["warc-type"], "refers_to": _page(r["warc-refers-to"]) if revisit else None,
                        "payload_digest": mark, "payload_bytes": None if revisit else len(r["block"]), "at": at, "size": size,
                    })
                out.sort(key=lambda x: order_of(x["urlkey"], x["captured_at"], x["page_id"], name, x["at"]))
                yield pa.RecordBatch.from_pylist([x | {"seq": k} for k, x in enumerate(out)], INDEX)

    return files.mapInArrow(run, INDEX_DDL)


_END = object()


def loser_tree(runs: Iterable[Iterable[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs, of which it holds one head each. tree[0] is the run with the least head; every other node holds the
    loser of its match. Of equal heads the run named first wins."""
    sources = [iter(r) for r in runs]
    k, heads = len(sources), [next(r, _END) for r in sources]
    if not k:
        return

    def less(a: int, b: int) -> bool:
        if heads[a] is _END:
            return False
        return heads[b] is _END or (heads[a], a) < (heads[b], b)

    tree, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if less(a, b) else (b, a)
    tree[0] = winners[1] if k > 1 else 0
    while heads[tree[0]] is not _END:
        won = tree[0]
        yield heads[won]
        heads[won] = next(sources[won], _END)
        node = (won + k) // 2
        while node:
            if less(tree[node], won):
                won, tree[node] = tree[node], won
            node //= 2
        tree[0] = won


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All index rows in global order by (part, pos): ranges of about range_rows rows, each merged from its runs."""
    parts = max(1, runs.count() // range_rows)
    ranged = runs.repartitionByRange(parts, "urlkey", "captured_at", F.asc_nulls_last("page_id"), "run", "at").sortWithinPartitions("run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), INDEX)
        names = rows["run"].to_pylist()
        bounds = [k for k in range(len(names)) if not k or names[k] != names[k - 1]] + [len(names)]
        columns = [rows[c].to_pylist() for c in ("urlkey", "captured_at", "page_id", "run", "at")]
        keyed = lambda a, z: ((order_of(*(c[k] for c in columns)), k) for k in range(a, z))
        part, pos = TaskContext.get().partitionId(), 0
        for some in batched(loser_tree([keyed(a, z) for a, z in zip(bounds, bounds[1:])]), 10_000):
            out = rows.take([k for _, k in some])
            out = out.append_column("part", pa.array([part] * len(some), pa.int32())).append_column("pos", pa.array(range(pos, pos + len(some)), pa.int64()))
            yield from out.combine_chunks().to_batches()
            pos += len(some)

    return ranged.mapInArrow(merge, INDEX_DDL + ", part int, pos long")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """The merged index with payload_bytes of revisits filled in from the response they refer to."""
    merged = durable(merge_runs(durable(read_runs(spark, path))))
    sizes = merged.where("record_type = 'response'").select(
        F.col("page_id").alias("r"), F.col("payload_digest").alias("of"), F.col("payload_bytes").alias("full")).distinct()
    asked = merged.where("record_type = 'revisit'").select(F.col("refers_to").alias("r"), F.col("payload_digest").alias("of")).distinct()
    sizes = durable(sizes.join(asked, ["r", "of"]))
    whole = merged.join(sizes, (F.col("refers_to") == F.col("r")) & (F.col("payload_digest") == F.col("of")), "left")
    return whole.withColumn("payload_bytes", F.coalesce("payload_bytes", "full")).drop("r", "of", "full")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return captures(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured_at", "part", "pos",
        F.element_at(F.split("run", "/"), -1).alias("archive"), "at", "size")
