"""An epoch's row beside the first row of the epoch after it: what a run logs for an epoch is known one epoch later.

In a batch this is a window; in a stream a run's rows are held in keyed state until the next epoch arrives. The last epoch is
flushed by a closing row, which a run sends when it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of this kind needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lagged(rows: DataFrame, key: str = "run", epoch: str = "epoch", closing: str = "closing") -> DataFrame:
    """``key, epoch, own, next``: each epoch's other columns as a struct, and those of the run's next epoch there is.

    A row with ``closing`` true is no epoch: it is what follows the last. Of repeated epochs the least row counts. An epoch that
    nothing follows yet is not in the result. Rows without a run or an epoch are left out.
    """
    rest = [c for c in rows.columns if c not in (key, epoch, closing)]
    once = rows.where(F.col(key).isNotNull() & F.col(epoch).isNotNull()).groupBy(key, epoch).agg(F.min(F.struct(F.coalesce(closing, F.lit(False)).alias("closing"), F.struct(*rest).alias("row"))).alias("r"))
    after = F.lead("r").over(Window.partitionBy(key).orderBy(epoch))
    found = once.withColumn("after", after).where("after IS NOT NULL AND NOT r.closing")
    return found.select(key, epoch, F.col("r.row").alias("own"), F.col("after.row").alias("next"))


class _Held(StatefulProcessor):
    """Rows of a run by epoch, until what follows them is there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getMapState("rows", "epoch int", "row string, closing boolean")
        self.done = handle.getValueState("done", "epoch int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: (v[0], v[1]) for k, v in self.rows.iterator()}
        done, had = self.done.get()[0] if self.done.exists() else None, set(held)
        for part in rows:
            for epoch, row, closing in sorted(zip(part["epoch"].tolist(), part["row"].tolist(), part["closing"].tolist())):
                # Epochs that have gone out, and repeated ones, are passed over.
                if (done is None or epoch > done) and epoch not in held:
                    held[epoch] = (row, bool(closing))
        out, order = [], sorted(held)
        ended = any(held[e][1] for e in order)
        for e, follows in zip(order, order[1:]):
            # An epoch waits for the one after it; when the run has ended, for the next there is.
            if held[e][1] or not (follows == e + 1 or ended):
                break
            out.append((key[0], e, held[e][0], held[follows][0]))
            done = e
            held.pop(e)
        for e in had - set(held):
            self.rows.removeKey((e,))
        for e in set(held) - had:
            self.rows.updateValue((e,), held[e])
        if out:
            self.done.update((done,))
        yield pd.DataFrame(out, columns=["key", "epoch", "own", "next"])

    def close(self) -> None:
        pass


def lagged_stream(rows: DataFrame, key: str = "run", epoch: str = "epoch", closing: str = "closing") -> DataFrame:
    """``lagged`` for a stream; the session's state store must be ``PROVIDER``.

    An epoch goes out when the one after it has come, in whatever order and batch rows arrive; a gap waits for the closing row,
    which flushes all that is held. Rows of an epoch that has gone out are passed over, so a source that repeats itself changes
    nothing. What is held of a run are its epochs out of order, not its past.
    """
    rest = [c for c in rows.columns if c not in (key, epoch, closing)]
    inner = T.StructType([rows.schema[c] for c in rest])
    kept = rows.where(F.col(key).isNotNull() & F.col(epoch).isNotNull())
    packed = kept.select(F.col(key).cast("string").alias("key"), F.col(epoch).cast("int").alias("epoch"), F.to_json(F.struct(*rest)).alias("row"), F.coalesce(closing, F.lit(False)).alias("closing"))
    out = packed.groupBy("key").transformWithStateInPandas(_Held(), "key string, epoch int, own string, next string", "Append", "None")
    parsed = lambda c: F.from_json(c, inner).alias(c)
    return out.select(F.col("key").cast(rows.schema[key].dataType).alias(key), F.col("epoch").cast(rows.schema[epoch].dataType).alias(epoch), parsed("own"), parsed("next"))
