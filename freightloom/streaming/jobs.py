"""Structured Streaming twins of the incremental batch jobs.

A job reads a table as a stream of files, runs until all available input is processed and writes to a table. Checkpoints lie
in the shared folder, so a restarted job goes on where it stopped.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from freightloom.session import prepare, setting, work_path


STORES = "spark.sql.streaming.stateStore.providerClass"


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with a proper event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return stream_table(spark, sf_dir, schema, glob="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def run_all(spark: SparkSession, writer: DataStreamWriter) -> None:
    """Run a stream until all available input is processed. Every shuffle partition of a stateful stream keeps stores of its own, which are written in
    each batch, so there are no more than two to a core; the stores lie on disk."""
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    with setting(spark, "spark.sql.shuffle.partitions", str(n)), setting(spark, STORES, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        running = writer.start()
    running.awaitTermination()


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input into a parquet table and return the table."""
    spark = prepare(stream.sparkSession)
    path = work_path(spark, name)
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option(
        "checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    run_all(spark, writer)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all available input; with a `checkpoint` folder of an earlier run, go on where that run stopped."""
    spark = prepare(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option(
        "checkpointLocation", checkpoint or f"{work_path(spark, name)}/checkpoint").trigger(availableNow=True)
    run_all(spark, writer)


def ingest_increments(stream: DataFrame, target: str, period: str = "period", name: str = "ingest", checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Append each period of arriving files once. Returns the store and its manifest: period, delivery, n_rows, checksum, status, batch.

    A delivery is the folder a file arrived in; a period's rows come whole in one delivery. The manifest guards the store: a period is accepted the first
    time it is seen (of several deliveries in a batch the first by name); later deliveries are `replayed` if their rows are the same (their count and an
    order-free checksum) and `conflict` otherwise, and neither is stored. A batch decides by the manifest rows of other batches and overwrites its own folders,
    so a batch that runs again after a failure leaves the store and the manifest as they were. The manifest has a row for each period and delivery.
    """
    spark = stream.sparkSession
    rows_at, manifest_at = f"{target}/rows", f"{target}/manifest"
    columns = stream.columns
    arriving = stream.withColumn("_delivery", F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1))

    def handle(batch: DataFrame, batch_id: int) -> None:
        digest = F.xxhash64(*columns).cast("decimal(20,0)")
        found = batch.groupBy(F.col(period).alias("_period"), "_delivery").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("string").alias("checksum"))
        schema = "_period string, _delivery string, n_rows long, checksum string, status string, batch int"
        known = spark.read.schema(schema).parquet(manifest_at).where((F.col("batch") != batch_id) & (F.col("status") == "accepted")) if manifest_exists() else spark.createDataFrame([], schema)
        first = found.groupBy("_period").agg(F.min("_delivery").alias("_first"), F.min_by(F.struct("n_rows", "checksum"), "_delivery").alias("_new"))
        before = known.select("_period", F.struct("n_rows", "checksum").alias("_old"))
        same = F.struct("n_rows", "checksum") == F.coalesce("_old", "_new")
        status = F.when(F.col("_old").isNull() & (F.col("_delivery") == F.col("_first")), "accepted").when(same, "replayed").otherwise("conflict")
        judged = found.join(first, "_period").join(before, "_period", "left").select("_period", "_delivery", "n_rows", "checksum", status.alias("status"))
        # The manifest is written last: a batch that fails before it is repeated as if it had not run.
        kept = batch.join(judged.where("status = 'accepted'").select(F.col("_period").alias(period), "_delivery"), [period, "_delivery"], "left_semi")
        kept.select(*columns).write.mode("overwrite").parquet(f"{rows_at}/batch={batch_id}")
        judged.write.mode("overwrite").parquet(f"{manifest_at}/batch={batch_id}")

    def manifest_exists() -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(manifest_at)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    run_batches(arriving, name, handle, checkpoint=checkpoint)
    return spark.read.parquet(rows_at).drop("batch"), spark.read.parquet(manifest_at).withColumnsRenamed({"_period": period, "_delivery": "delivery"})


def dedup(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """One row per key, repeats within the watermark dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def windowed_kpis(stream: DataFrame, ts: str, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding KPIs per event type, emitted once the watermark has passed the window."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return stream.withWatermark(ts, delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", "total"
    )


def session_kpis(stream: DataFrame, ts: str, delay: str, gap: str) -> DataFrame:
    """An addition of ours: activity sessions per user."""
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n"
    )


def deviation_join(forecasts: DataFrame, actuals: DataFrame, floor: float = 0.10) -> DataFrame:
    """Forecast and actual streams matched on entity and date; deviations of at least `floor` pass."""
    f = forecasts.withWatermark("ts", "7 days")
    a = actuals.withWatermark("ts", "7 days").select(
        F.col("entity_type").alias("at"), F.col("entity_id").alias("ai"), F.col("ts").alias("ats"), "actual")
    d = f.join(a, (F.col("entity_type") == F.col("at")) & (F.col("entity_id") == F.col("ai")) & (F.col("ts") == F.col("ats")))
    pct = F.coalesce(F.abs(F.try_divide(F.col("actual") - F.col("predicted"), F.col("predicted"))), F.lit(0.0))
    return d.withColumn("pct", F.round(pct, 6)).where(pct >= floor).select("entity_type", "entity_id", "ts", "predicted", "actual", "pct")


LINK_PARTS = 8  # parts the partners of an entity are dealt to: an entity of the catalogue may be linked with every supplier


def sequence_join(x: DataFrame, y: DataFrame, network: DataFrame, lag_days: int = 7) -> DataFrame:
    """A then B along the network: the second event within (ts, ts + lag] of the first, of an entity linked with it.

    `x` and `y` are two readings of one stream of events, for the two sides of the edges. Events of x sides, whose entities have few edges each, are dealt to
    these (a join with a static table); events of y sides alone, which are few, come in the time buckets around their own and in every part of their
    partners. So one join, on entity, bucket and part, by which its state is partitioned, finds both orders and keeps an event once an edge.
    """
    slot = F.floor(F.unix_seconds("ts") / (86400 * lag_days))
    dealt = x.join(network, (F.col("entity_type") == F.col("x_type")) & (F.col("entity_id") == F.col("x_id"))).withWatermark("ts", "7 days").select(
        slot.alias("slot"), F.pmod(F.xxhash64("x_id"), F.lit(LINK_PARTS)).cast("int").alias("part"), F.col("y_type").alias("to_type"), F.col("y_id").alias("to_id"),
        F.col("x_id").alias("x_entity"), F.col("event").alias("x_event"), F.col("ts").alias("x_ts"))
    ends = network.select(F.col("y_type").alias("entity_type"), F.col("y_id").alias("entity_id")).distinct()
    around = F.transform(F.array(slot - 1, slot, slot + 1), lambda s: F.transform(F.sequence(F.lit(0), F.lit(LINK_PARTS - 1)), lambda p: F.struct(s.alias("s"), p.alias("p"))))
    few = y.join(ends, ["entity_type", "entity_id"], "left_semi").withColumn("at", F.explode(F.flatten(around))).withWatermark("ts", "7 days").select(
        F.col("at.s").alias("y_slot"), F.col("at.p").alias("y_part"), F.col("entity_type").alias("y_type"), F.col("entity_id").alias("y_entity"), F.col("event").alias("y_event"), F.col("ts").alias("y_ts"))
    lag = F.expr(f"INTERVAL {lag_days} DAYS")
    near = (
        (F.col("slot") == F.col("y_slot")) & (F.col("part") == F.col("y_part")) & (F.col("to_type") == F.col("y_type")) & (F.col("to_id") == F.col("y_entity"))
        & (F.col("x_ts") <= F.col("y_ts") + lag) & (F.col("x_ts") >= F.col("y_ts") - lag) & (F.col("x_ts") != F.col("y_ts"))
    )
    first = lambda c, other: F.when(F.col("x_ts") < F.col("y_ts"), F.col(c)).otherwise(F.col(other))
    sides = ("event", "entity", "ts")
    return dealt.join(few, near).select(*[c for n in sides for c in (first(f"x_{n}", f"y_{n}").alias(f"a_{n}"), first(f"y_{n}", f"x_{n}").alias(f"b_{n}"))])


EDGE_LOG = "edge string, day long, action string, weight_before double, weight double, hits long"
EDGE_STATE = "weight double, hits long, last long, late long"
PASS_DAYS, CREATED = 30, 0.4  # days without a hit until an edge decays by itself; weight of a new edge, and share of a hit in a strengthened one
DECAY, LEAST, SEASON, SEASON_FLOOR = 0.05, 0.1, (11, 12), 0.40
_DAY_MS = 86_400_000


class EdgeLife(StatefulProcessor):
    """Life of one edge: created or strengthened by a day with hits, decayed by event-time timers, removed when too light.

    A pass is due 30 days after the last change. Passes due before a hit are made up when the hit arrives, and the timer makes them when no hit
    does, so the log depends on the days of the hits and the watermark and not on how hits are cut into batches. A day not after the last change is late: it is
    told apart in the log and changes nothing. Once an edge is removed its state is gone; a later hit creates it anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.edge = handle.getValueState("edge", EDGE_STATE)

    @staticmethod
    def left(weight: float, last: int, day: int) -> float:
        """Weight after the days since the last change; November and December decay at half the rate and not below a floor."""
        season = (datetime.date(1970, 1, 1) + datetime.timedelta(days=day)).month in SEASON
        rest = weight * (1.0 - (DECAY * 0.5 if season else DECAY)) ** (day - last)
        return max(rest, SEASON_FLOOR) if season else rest

    def passes(self, state: tuple | None, until: int, log: list) -> tuple | None:
        """Make the passes due before `until` (a day)."""
        while state is not None and state[2] + PASS_DAYS < until:
            weight, hits, last, late = state
            day = last + PASS_DAYS
            rest = self.left(weight, last, day)
            if rest < LEAST:
                log.append((day, "edge_removed", weight, 0.0, hits))
                state = None
            else:
                log.append((day, "edge_decayed", weight, rest, hits))
                state = (rest, hits, day, late)
        return state

    def keep(self, before: tuple | None, state: tuple | None) -> None:
        due = lambda s: (s[2] + PASS_DAYS) * _DAY_MS
        if before is not None and (state is None or due(before) != due(state)):
            self.handle.deleteTimer(due(before))
        if state is None:
            self.edge.clear()
            return
        self.edge.update(state)
        if before is None or due(before) != due(state):
            self.handle.registerTimer(due(state))

    def rows(self, key: tuple, log: list) -> Iterator[pd.DataFrame]:
        if log:
            out = pd.DataFrame(log, columns=["day", "action", "weight_before", "weight", "hits"])
            out.insert(0, "edge", key[0])
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = state = tuple(self.edge.get()) if self.edge.exists() else None
        days = pd.concat([f[["day", "n"]] for f in rows]).groupby("day")["n"].sum().sort_index()
        log: list = []
        for day, n in ((int(d), int(k)) for d, k in days.items()):
            if state is not None and day <= state[2]:
                weight, hits, last, late = state
                state = (weight, hits, last, late + n)
                log.append((day, "late", weight, weight, hits))
                continue
            state = self.passes(state, day, log)
            if state is None:
                state = (CREATED, n, day, 0)
                log.append((day, "edge_created", None, CREATED, n))
            else:
                weight, hits, last, late = state
                stronger = min(self.left(weight, last, day) * (1.0 - CREATED) + CREATED, 1.0)
                state = (stronger, hits + n, day, late)
                log.append((day, "edge_strengthened", weight, stronger, hits + n))
        self.keep(before, state)
        yield from self.rows(key, log)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = tuple(self.edge.get()) if self.edge.exists() else None
        log: list = []
        self.keep(before, self.passes(before, timerValues.getCurrentWatermarkInMs() // _DAY_MS, log))
        yield from self.rows(key, log)

    def close(self) -> None:
        pass


def edge_life(hits: DataFrame, delay: str) -> DataFrame:
    """Log of all changes of edges. `hits` has edge, ts (timestamp of a day), day (number of that day) and n (hits of the day).

    State is kept per edge in RocksDB, so it is not bounded by memory; edges without hits leave it.
    """
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return hits.withWatermark("ts", delay).groupBy("edge").transformWithStateInPandas(EdgeLife(), EDGE_LOG, "Append", "EventTime")


def memory_accuracy(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions joined with the actuals that arrive for them, within the watermark of both."""
    p = predictions.withWatermark("ts", "31 days")
    a = actuals.withWatermark("ts", "31 days").select(F.col("record_id").alias("rid"), F.col("ts").alias("ats"), "actual")
    d = p.join(a, (F.col("record_id") == F.col("rid")) & (F.col("ats") >= F.col("ts")) & (F.col("ats") <= F.col("ts") + F.expr("INTERVAL 31 DAYS")), "left_outer")
    gap = F.abs(F.col("prediction") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1.0))
    return d.select("record_id", "agent", "ts", "prediction", "actual", F.greatest(1 - gap, F.lit(0.0)).alias("accuracy"))
