"""What the operators on conversations share: their rows in order across partitions, and Python steps over ordered rows.

A conversation may be any share of all rows. Rows are dealt by ranges of (conversation, turn, ...), so a long conversation
lies across many partitions, and each task streams over what it has. Nothing holds a whole conversation's texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows, or characters in them, after which a task sends on what it has made.
BATCH_ROWS, BATCH_CHARS = 512, 1 << 22

COLUMNS = ["conv_id", "turn", "role", "text"]


def in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by ``conv_id``, then ``turn``, then ``role`` (nulls first in each), then the text's first 64 characters and hash.

    Sorted within partitions that follow each other, as many rows each, whatever the conversations' lengths: equal rows
    are told apart by a number, so that even they spread.
    """
    keyed = rows.withColumns({"_start": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_start", "_hash", "_at")]
    return keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_start", "_hash", "_at")


def partition() -> int:
    return TaskContext.get().partitionId()


def in_tasks(df: DataFrame, schema: T.StructType, step: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Apply ``step`` to the rows of each partition as tuples; it yields tuples of ``schema``. One Arrow batch is in memory at a time."""
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        made, chars = [], 0
        for row in step(row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])):
            made.append(row)
            chars += sum(len(x) for x in row if isinstance(x, (str, list, np.ndarray)))
            if len(made) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield sent(made)
                made, chars = [], 0
        if made:
            yield sent(made)

    return df.mapInArrow(run, schema)
