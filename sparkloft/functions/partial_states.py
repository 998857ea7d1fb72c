"""Users' aggregates in Python whose groups are never gathered: a task keeps a state for each key it meets and sends the states; Spark merges
them by key in two steps. A group with most of the rows is thus as many small states as there are tasks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

#: A task sends its states and begins anew when it holds this many keys; a key's states are merged in PIECES groups first.
MOST_KEYS, PIECES = 10_000, 64


class PartialAggregate(ABC):
    """An aggregate of one column by states of a few doubles. Null values are left out before."""

    @abstractmethod
    def start(self) -> np.ndarray: ...

    @abstractmethod
    def add(self, state: np.ndarray, values: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def finish(self, state: np.ndarray) -> float | None:
        """The result; None if there is none."""


def aggregated(rows: DataFrame, keys: list[str], value: str, how: PartialAggregate, name: str) -> DataFrame:
    """keys and `name` (double): a row for each group, also for groups (and null keys) whose values are all null."""
    kept = [rows.schema[k] for k in keys]
    sent = StructType([*kept, StructField("_task", LongType()), StructField("_state", ArrayType(DoubleType()))])
    done = StructType([*kept, StructField(name, DoubleType())])
    sent_arrow, done_arrow = to_arrow_schema(sent), to_arrow_schema(done)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], f.type) for i, f in enumerate(sent_arrow) if i < len(keys)]
            task = TaskContext.get().partitionId()
            return pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(held), pa.int64()), pa.array([s.tolist() for s in held.values()], pa.list_(pa.float64()))], schema=sent_arrow)

        for b in batches:
            numbers: dict[tuple, int] = {}
            codes = np.fromiter((numbers.setdefault(k, len(numbers)) for k in zip(*(b.column(i).to_pylist() for i in range(len(keys))))), int, b.num_rows)
            values = b.column(len(keys)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            there = ~b.column(len(keys)).is_null().to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            for key, at in zip(numbers, np.split(order, np.cumsum(np.bincount(codes, minlength=len(numbers)))[:-1])):
                held[key] = how.add(held[key] if key in held else how.start(), values[at[there[at]]])
            if len(held) > MOST_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    def together(parts: pa.Table) -> np.ndarray:
        first, *rest = [np.array(s) for s in parts.sort_by("_task")["_state"].to_pylist()]
        for s in rest:
            first = how.merge(first, s)
        return first

    own = lambda parts: [parts[k].slice(0, 1).combine_chunks() for k in keys]

    def merged(parts: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([*own(parts), pa.array([0], pa.int64()), pa.array([together(parts).tolist()], pa.list_(pa.float64()))], schema=sent_arrow)

    def finished(parts: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([*own(parts), pa.array([how.finish(together(parts))], pa.float64())], schema=done_arrow)

    made = rows.select(*keys, value).mapInArrow(states, sent).withColumn("_piece", F.pmod("_task", F.lit(PIECES)))
    first = made.groupBy(*keys, "_piece").applyInArrow(lambda parts: merged(parts.drop_columns("_piece")), sent)
    return first.groupBy(*keys).applyInArrow(finished, done)
