"""Registered queries against DuckDB at the smallest scale (all of them with SPOTWEAVE_ALL=1)."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from spotweave.plans.registry import QUERIES
from tools.check_oracle import TABLES, TYPES, normal

QUICK = ("scene_segments", "prefilter", "title_match", "keyword_tags", "timeline_scan", "stride_samples", "frame_density",
         "active_overlays", "overlay_layout", "served_overlays", "schedule_spacing", "training_set", "rank_metrics",
         "stream_ingest_dedup", "stream_feedback_latest", "stream_impressions", "stream_gap_scenes")


def test_every_query_has_a_statement():
    """Of the library itself; some corpus operators are beyond SQL and have tests of their own."""
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("SPOTWEAVE_ALL") else QUICK)
def test_query_matches(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    rel = con.sql(entry.oracle_sql()[name])
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    ours = normal(df.toArrow().to_pandas(types_mapper=pd.ArrowDtype))
    theirs = normal(rel.to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype))
    assert len(ours) > 0 and ours.equals(theirs)


def test_streamed_progress_equals_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    from spotweave.operators.serving import watch_progress
    from spotweave.plans.queries_streams import EVENTS
    from spotweave.sources import fixtures as fx
    from spotweave.streaming import jobs as st
    durations = spark.range(100).select(F.col("id").alias("job_id"), F.lit(720_000).alias("duration_ms"))
    stream = fx.playback_of(st.table_stream(spark, sf_dir, "events.parquet", EVENTS))
    streamed = st.stream_watch_progress(stream, durations)
    batch = watch_progress(fx.playback(spark, sf_dir), durations)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
