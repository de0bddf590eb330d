"""Example priorities kept up to date by a stream of losses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sampling import updated_priority
from ..sources.tables import shared_dir


def loss_stream(spark: SparkSession, path: str, *more: str) -> DataFrame:
    """The events table's files as a stream of (user_id, event_id, value) and more columns."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).select("user_id", "event_id", "value", *more)


def priorities(losses: DataFrame, iteration: int) -> DataFrame:
    """(user_id, prio) by the mean loss, the visits and the last visit of each example; state is a row for each example."""
    seen = losses.groupBy("user_id").agg(F.avg(F.abs("value")).alias("nll"), F.count("*").alias("visits"), F.max(F.col("event_id") % 1000).alias("last"))
    return seen.select("user_id", updated_priority(F.col("nll"), F.col("visits"), F.lit(iteration), F.col("last")).alias("prio"))


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Runs a complete-mode stream over all that is there and gives its last table; each batch replaces a folder of its own."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")
        last.append(number)

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{base}-state").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/batch={last[-1]}")


class Visits(StatefulProcessor):
    """An example's sum of losses, visits and last visit; gone when no visit came for so long."""

    def __init__(self, key: str, iteration: int, forget_ms: int | None) -> None:
        self.key, self.iteration, self.forget_ms = key, iteration, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "total double, visits long, last long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        total, visits, last, until = self.seen.get() if self.seen.exists() else (0.0, 0, -1, -1)
        before = until
        if before >= 0 and before <= timerValues.getCurrentWatermarkInMs():  # due, but rows are handled before timers
            total, visits, last = 0.0, 0, -1
        for df in rows:
            total, visits, last = total + float(df["loss"].abs().sum()), visits + len(df), max(last, int(df["visit"].max()))
            if self.forget_ms is not None:
                until = max(until, int(df["ms"].max()) + self.forget_ms)
        if until != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        self.seen.update((total, visits, last, until))
        yield pd.DataFrame({self.key: [key[0]], "prio": [updated_priority(total / visits, visits, self.iteration, last)], "live": [True]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.seen.clear()
        yield pd.DataFrame({self.key: [key[0]], "prio": [0.0], "live": [False]})

    def close(self) -> None:
        pass


#: Batches of changes after which their log is folded into one table.
FOLD = 32


class Changes:
    """A stream of changed priorities (key, prio, live) kept as a table: each batch adds its own rows alone, and every FOLD batches the log is folded."""

    def __init__(self, spark: SparkSession, key: str, path: str, fold: int = FOLD) -> None:
        self.spark, self.key, self.path, self.fold = spark, key, path, fold
        self.folded, self.batches = -1, []

    def put(self, batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/changes-{number}")
        self.batches = [*(b for b in self.batches if b != number), number]
        if len(self.batches) >= self.fold:
            self.latest().write.mode("overwrite").parquet(f"{self.path}/folded-{number}")
            self.folded, self.batches = number, []

    def latest(self) -> DataFrame:
        """Each key's last row."""
        paths = [f"{self.path}/changes-{b}" for b in self.batches] + ([f"{self.path}/folded-{self.folded}"] if self.folded >= 0 else [])
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy(self.key).agg(F.max_by(F.struct("prio", "live", "batch"), "batch").alias("r")).select(self.key, "r.prio", "r.live", "r.batch")

    def current(self) -> DataFrame:
        return self.latest().where("live").select(self.key, "prio")


def kept_priorities(losses: DataFrame, key: str, iteration: int, forget: str | None = None, label: str = "kept-priorities", fold: int = FOLD) -> Changes:
    """Runs a stream of losses (key, visit, loss, ts) over all that is there; priorities are kept in a state a key, of which a batch reads and writes those of its own rows alone.

    forget: an interval such as "3 days"; examples without a visit for so long, by the stream's watermark, are dropped from state and table.
    """
    spark = losses.sparkSession
    base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = losses.withColumn("ts", F.col("ts").cast("timestamp")).select(key, "visit", "loss", F.unix_millis("ts").alias("ms"), "ts")
        forget_ms = None
        if forget is not None:
            forget_ms = int(spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + INTERVAL {forget}) AS ms").first()["ms"])
            rows = rows.withWatermark("ts", "0 seconds")
        kind = losses.schema[key].dataType.simpleString()
        changed = rows.groupBy(key).transformWithStateInPandas(Visits(key, iteration, forget_ms), f"{key} {kind}, prio double, live boolean", "Update", "EventTime" if forget else "None")
        changes = Changes(spark, key, base, fold)
        changed.writeStream.outputMode("update").option("checkpointLocation", f"{base}-state").foreachBatch(changes.put).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return changes
