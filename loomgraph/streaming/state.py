"""Streams with state: what is known of each entity so far, and the closure of a growing graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.infer import closure
from ..plans.written import written

STATE = "n long, late long, first_ts long, first_seq long, last_ts long, last_seq long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Mentions(StatefulProcessor):
    """The state of one slot of an entity, folded in the order of seq."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, late, first_ts, first_seq, last_ts, last_seq = self.known.get() if self.known.exists() else (0, 0, None, None, None, None)
        seq, ts = (np.concatenate(x) for x in zip(*((r["seq"].to_numpy(), r["ts"].to_numpy()) for r in rows)))
        order = np.lexsort((ts, seq))
        seq, ts = seq[order], ts[order]
        before = np.maximum.accumulate(np.append(ts[0] if last_ts is None else last_ts, ts))[:-1]
        n, late = n + len(ts), late + int((ts < before - self.delay).sum())
        by_time = np.lexsort((seq, ts))
        low, high = ((int(ts[k]), int(seq[k])) for k in (by_time[0], by_time[-1]))
        first_ts, first_seq = low if first_ts is None else min(low, (first_ts, first_seq))
        last_ts, last_seq = high if last_ts is None else max(high, (last_ts, last_seq))
        self.known.update((n, late, first_ts, first_seq, last_ts, last_seq))
        yield pd.DataFrame({"uri": [key[0]], "slot": [key[1]], "n": [n], "late": [late], "first_ts": [first_ts], "first_seq": [first_seq], "last_ts": [last_ts], "last_seq": [last_seq]})

    def close(self) -> None:
        pass


def slotted(mentions: DataFrame, slots: int) -> DataFrame:
    """uri, slot, seq and ts in microseconds of mentions (uri, seq, ts). An entity's mentions are dealt to slots by their number, so that one
    that a third of the stream names is not one task's work. Rows with a null are left out."""
    return mentions.select("uri", F.pmod("seq", F.lit(slots)).cast("int").alias("slot"), F.col("seq").cast("long").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).dropna()


def entity_updates(mentions: DataFrame, slots: int = 8, delay: int = 3600) -> DataFrame:
    """A stream of (uri, slot, n, late, first_ts, first_seq, last_ts, last_seq) from a stream of mentions (uri, seq, ts): a row for each slot of an
    entity that a batch names, with all that is known of it by then. late counts mentions more than `delay` seconds before the
    latest that the slot has seen; they count like others. seq must grow from batch to batch, in any batching.

    State is kept by the RocksDB provider, which the session that starts the stream names in spark.sql.streaming.stateStore.providerClass
    (STATE_STORE)."""
    x = slotted(mentions, slots)
    return x.groupBy("uri", "slot").transformWithStateInPandas(_Mentions(delay * 1_000_000), f"uri string, slot int, {STATE}", "Append", "None")


def entity_table(updates: DataFrame) -> DataFrame:
    """uri, n, late, first_seq, last_seq: what the updates so far say of each entity: the last state of each slot, put together."""
    last = updates.groupBy("uri", "slot").agg(F.max_by(F.struct("late", "first_ts", "first_seq", "last_ts", "last_seq"), "n").alias("x"), F.max("n").alias("n")).select("uri", "n", "x.*")
    return last.groupBy("uri").agg(
        F.sum("n").alias("n"), F.sum("late").alias("late"), F.min(F.struct("first_ts", "first_seq"))["first_seq"].alias("first_seq"), F.max(F.struct("last_ts", "last_seq"))["last_seq"].alias("last_seq")
    )


class GrowingClosure:
    """The closure of a graph whose edges come in batches, kept in a folder: a part for each batch with the pairs that it added.

    Ways that a batch adds go over what is known, then over its edges, each perhaps with a known way after it, so its new edges are
    closed among themselves and then put behind what is known, once. A batch that is run again (after a failure) overwrites its own part from the parts before it, and gives the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _part(self, batch: int) -> str:
        return f"{self.path}/batch-{batch:09d}"

    def _batches(self) -> list[int]:
        """Batches whose part is whole."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()[6:]) for s in found.getFileSystem(conf).globStatus(found) or [])

    def pairs(self, before: int | None = None, spark: SparkSession | None = None) -> DataFrame:
        """(s, o) of all parts, or of those before a batch."""
        spark, parts = spark or self.spark, [self._part(b) for b in self._batches() if before is None or b < before]
        return spark.read.schema("s string, o string").parquet(*parts) if parts else spark.createDataFrame([], "s string, o string")

    def extend(self, edges: DataFrame, batch: int) -> None:
        """Add the edges (s, o) of a batch; the function of a stream's foreachBatch. Edges with a null end are none."""
        known = self.pairs(batch, edges.sparkSession)  # a stream runs in a session of its own
        new = written(edges.select("s", "o").filter("s is not null and o is not null").distinct().join(known, ["s", "o"], "left_anti"), "delta")
        longer = new.select("s", F.col("o").alias("m")).join(known.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        ways = closure(new.unionByName(longer))
        after = known.select("s", F.col("o").alias("m")).join(ways.select(F.col("s").alias("m"), "o"), "m").select("s", "o")
        added = ways.unionByName(after).distinct().join(known, ["s", "o"], "left_anti")
        added.write.mode("overwrite").parquet(self._part(batch))
