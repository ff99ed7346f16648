"""Structured Streaming jobs; each one drains what is available and returns the resulting table.

State that only needs the latest value is kept as an append-only log of per-batch results, one
folder per batch id, so a replayed batch overwrites itself; the latest-value view is a
map-side-combining aggregation over the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.operators.segments import gap_scenes
from spotweave.operators.serving import active_overlays, watch_progress
from spotweave.operators.skew import pick_by
from spotweave.session import fresh_path
from spotweave.settings import SEGMENTATION, SegmentationSettings


def table_stream(spark: SparkSession, folder: str, file_glob: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder that match the glob, all at once or so many per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Append the stream to a Parquet table until no input is left."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    writer = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/table")
              .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def drain_log(stream: DataFrame, name: str, per_batch: Callable[[DataFrame], DataFrame],
              mode: str = "append") -> DataFrame:
    """Write ``per_batch`` of every micro-batch to its own folder; returns the log with ``batch``."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        per_batch(batch).write.mode("overwrite").parquet(f"{path}/log/batch={batch_id}")

    writer = (stream.writeStream.outputMode(mode).foreachBatch(write)
              .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True))
    writer.start().awaitTermination()
    return spark.read.option("basePath", f"{path}/log").parquet(f"{path}/log")


def ingest(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows once per natural key, however late they are delivered again.

    Natural keys do not expire, so their state is kept for good, spread over the tasks by key; on large
    streams use the RocksDB state store, which keeps it on disk.
    """
    return stream.dropDuplicates(list(keys))


def latest_feedback(stream: DataFrame, decisions: DataFrame) -> DataFrame:
    """Last valid label per existing decision; ``stream``: decision_id, label, source, ts, event_id."""
    def per_batch(batch: DataFrame) -> DataFrame:
        valid = batch.filter(F.col("label").isin(-1, 0, 1))
        last = pick_by(valid, ["decision_id"], [F.col("ts"), F.col("event_id")], last=True)
        return last.join(decisions.select("decision_id"), "decision_id", "left_semi")

    log = drain_log(stream, "feedback", per_batch)
    return pick_by(log.drop("batch"), ["decision_id"], [F.col("ts"), F.col("event_id")], last=True)


PHASES = {"complete": "done", "failed": "failed"}


def job_phase(status: Column) -> Column:
    phase = F.lit("running")
    for name, shown in PHASES.items():
        phase = F.when(status == name, F.lit(shown)).otherwise(phase)
    return phase


def latest_status(stream: DataFrame) -> DataFrame:
    """Newest status per job from a stream of (job_id, status, ts, event_id)."""
    newest = stream.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("s"))
    log = drain_log(newest.select("job_id", "s.*"), "status", lambda batch: batch, mode="update")
    last = pick_by(log, ["job_id"], [F.col("batch")], last=True)
    return last.select("job_id", "status", F.col("ts").alias("updated_at"), job_phase(F.col("status")).alias("phase"))


def impressions(stream: DataFrame, overlays: DataFrame) -> DataFrame:
    """Heartbeats with an overlay on screen, counted per ad."""
    def per_batch(batch: DataFrame) -> DataFrame:
        return active_overlays(batch, overlays).groupBy("ad_id").agg(F.count("*").alias("n"))

    log = drain_log(stream, "impressions", per_batch)
    return log.groupBy("ad_id").agg(F.sum("n").alias("n_impressions"))


def stream_watch_progress(stream: DataFrame, durations: DataFrame) -> DataFrame:
    """Same result as the batch operator, from a stream of heartbeats."""
    def per_batch(batch: DataFrame) -> DataFrame:
        return pick_by(batch.select("viewer_id", "job_id", "ts", "event_id", "pos_ms"), ["viewer_id", "job_id"],
                       [F.col("ts"), F.col("event_id")], last=True)

    return watch_progress(drain_log(stream, "progress", per_batch).drop("batch"), durations)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stream_gap_scenes(stream: DataFrame, cfg: SegmentationSettings = SEGMENTATION) -> DataFrame:
    """Scenes split on speech gaps, for the jobs whose end has been seen: those of the batch rule.

    ``stream``: job_id, seg_id, start_ms, end_ms, ended. A row with ``ended`` says that its job is over and holds no segment; rows
    without a start or an end are left out. The state, in RocksDB, is keyed by segment: one of a known (job, start, number) changes nothing, in
    whatever order they come. A micro-batch touches the keys of its own rows, appends what is new and reads nothing back; the segments
    of ended jobs are put in order once, when the scenes are read.
    """
    ended = F.coalesce("ended", F.lit(False))
    rows = (stream.filter(ended | (F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()))
            .select("job_id", *[F.when(~ended, F.col(c)).alias(c) for c in ("seg_id", "start_ms", "end_ms")], ended.alias("ended")))
    with _setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        held = drain(ingest(rows, ["job_id", "ended", "start_ms", "seg_id"]), "gap-scenes")
    over = held.filter("ended").select("job_id")
    segments = held.filter("NOT ended").drop("ended").join(over, "job_id", "left_semi")
    return gap_scenes(segments, cfg).drop("scene_no")
