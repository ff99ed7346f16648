"""Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.plans.queries_placement import decided_overlays
from spotweave.plans.registry import query
from spotweave.sources import fixtures as fx
from spotweave.streaming import jobs as st

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _events(spark, d):
    return st.table_stream(spark, d, "events.parquet", EVENTS)


def _segments(spark, d):
    return fx.transcript_of(_events(spark, d))


@query("stream_ingest_dedup")
def q_ingest(spark, d):
    """Every segment is delivered twice and stored once."""
    twice = _segments(spark, d).union(_segments(spark, d))
    stored = st.drain(st.ingest(twice, ["job_id", "start_ms", "end_ms", "text"]), "segments")
    return stored.select("job_id", "start_ms", "end_ms", "text")


@query("stream_feedback_latest")
def q_feedback(spark, d):
    stream = _events(spark, d).selectExpr(
        "event_id % 3000 AS decision_id", "CAST((event_id * 7) % 4 - 1 AS INT) AS label",
        "CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'auto' END AS source", "ts", "event_id")
    return st.latest_feedback(stream, fx.decisions(spark, d)).select("decision_id", "label", "source", "event_id")


@query("stream_job_status")
def q_status(spark, d):
    stream = _events(spark, d).selectExpr(
        "user_id AS job_id", "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' "
        "WHEN 'signup' THEN 'pending' ELSE 'analysing' END AS status", "ts", "event_id")
    return st.latest_status(stream)


@query("stream_impressions")
def q_impressions(spark, d):
    stream = fx.playback_of(_events(spark, d)).withColumn("ended", F.lit(False))
    return st.impressions(stream, decided_overlays(spark, d))


@query("stream_gap_scenes")
def q_gap_scenes(spark, d):
    """Gap scenes of the jobs that a purchase has closed."""
    rows = _segments(spark, d).withColumn("ended", F.explode(F.when(
        F.col("text") == "purchase", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return st.stream_gap_scenes(rows)
