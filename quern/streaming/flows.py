"""Flows over growing tables: progress of loaders, state machines, windows, resumable ingestion.

Each flow is a function of a streaming (or plain) DataFrame. ``drained`` runs
one over what there is now and returns its result as a table: sinks are Parquet
below the shared scratch folder, and so are checkpoints, so a query that is
stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import scratch_path, share_code


def followed(spark: SparkSession, sf_dir: str, name: str, files_at_once: int = 1) -> DataFrame:
    """A table as a stream: new Parquet files below the folder that fit the name, so many a batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def drained(flow: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a streaming DataFrame has given when all input is read; in update and complete mode every batch is numbered and the last value of a key is for the caller to pick (``batch``)."""
    spark = flow.sparkSession
    path = scratch_path(spark)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    writer = flow.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    out = f"{path}/out"
    place = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], flow.schema).withColumn("batch", F.lit(0))
    return spark.read.parquet(out)


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """Of each key the row of its last batch."""
    w = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "batch")


def load_progress(fragments: DataFrame, total: int = 60, essential: int = 12) -> DataFrame:
    """STM4-5: per tensor (user_id) the fragments loaded, whether its essentials are there (one of every fifth), and quality; a running aggregate with map-side sums."""
    first = F.count_if(F.col("event_id") % 5 == 0)
    g = fragments.groupBy("user_id").agg(F.count(F.lit(1)).alias("loaded"), first.alias("essentials"))
    return g.select("user_id", "loaded", "essentials", (F.col("essentials") >= essential).alias("ready"), F.round(F.least(F.col("loaded") / float(total), F.lit(1.0)), 6).alias("quality"))


def model_progress(tensors: DataFrame) -> DataFrame:
    """STM5: one row: tensors, ready ones, mean quality (1 without any)."""
    return tensors.agg(F.count(F.lit(1)).alias("tensors"), F.count_if("ready").alias("ready"), F.round(F.coalesce(F.avg("quality"), F.lit(1.0)), 6).alias("progress"))


#: STM6: what each kind of event does to a stream; start works from any state, pause while running, resume while paused, others always.
MOVES = {"signup": "start", "click": "pause", "view": "resume", "error": "cancel", "purchase": "complete"}


def moved(state: str, event: str) -> str:
    """STM6: the state after an event; events that don't fit leave it as it is."""
    move = MOVES.get(event)
    if move == "start":
        return "Running"
    if move == "pause":
        return "Paused" if state == "Running" else state
    if move == "resume":
        return "Running" if state == "Paused" else state
    if move == "cancel":
        return "Cancelled"
    return "Completed" if move == "complete" and state == "Running" else state


def stream_states(events: DataFrame) -> DataFrame:
    """STM6: (user_id, state, steps) after each batch, kept in Spark's state store; within a batch events are taken in order of time."""
    share_code(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("Idle", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for e in rows["event_type"]:
            now, n = moved(now, e), n + 1
        state.update((now, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "steps": [n]})

    keyed = events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(step, "user_id long, state string, steps long", "state string, steps long", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events and value by window and type, with a watermark (provided by Spark)."""
    t = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return t.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def ingested(spark: SparkSession, source: DataFrame, path: str) -> int:
    """SRC12, STM14: append what is new in a stream to a table; a second run over the same source and path adds nothing. How many rows there are."""
    writer = source.writeStream.option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True)
    writer.format("parquet").start().awaitTermination()
    return spark.read.parquet(f"{path}/rows").count()


def _streamed(flow: Callable[[DataFrame], DataFrame], mode: str, *key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return latest(drained(flow(followed(spark, sf_dir, "events")), mode), *key)

    return run


def _ingest_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    first = ingested(spark, followed(spark, sf_dir, "events"), path)
    return spark.createDataFrame([(first, ingested(spark, followed(spark, sf_dir, "events"), path))], "first long, again long")


QUERIES = {
    "stream_progress": _streamed(load_progress, "update", "user_id"),
    "stream_model_progress": lambda s, d: model_progress(latest(drained(load_progress(followed(s, d, "events")), "update"), "user_id")),
    "stream_states": _streamed(stream_states, "update", "user_id"),
    "stream_windows": _streamed(windowed, "update", "start", "event_type"),
    "stream_ingest": _ingest_twice,
}
_P = "WITH p AS (SELECT user_id, count(*) AS loaded, count(*) FILTER (event_id % 5 = 0) AS essentials, count(*) FILTER (event_id % 5 = 0) >= 12 AS ready, round(least(count(*) / 60.0::DOUBLE, 1), 6) AS quality FROM events GROUP BY 1)"
_MOVE = "CASE x WHEN 'signup' THEN 'Running' WHEN 'click' THEN CASE a WHEN 'Running' THEN 'Paused' ELSE a END WHEN 'view' THEN CASE a WHEN 'Paused' THEN 'Running' ELSE a END WHEN 'error' THEN 'Cancelled' WHEN 'purchase' THEN CASE a WHEN 'Running' THEN 'Completed' ELSE a END ELSE a END"
ORACLE_SQL = {
    "stream_progress": f"{_P} SELECT * FROM p",
    "stream_model_progress": f"{_P} SELECT count(*) AS tensors, count(*) FILTER (ready) AS ready, round(avg(quality), 6) AS progress FROM p",
    "stream_states": f"WITH l AS (SELECT user_id, ['Idle'] || list(event_type ORDER BY ts, event_id) AS l FROM events GROUP BY 1) SELECT user_id, list_reduce(l, lambda a, x: {_MOVE}) AS state, len(l) - 1 AS steps FROM l",
    "stream_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_ingest": "SELECT count(*) AS first, count(*) AS again FROM events",
}
