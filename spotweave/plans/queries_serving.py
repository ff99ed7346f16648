"""Serving and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import serving as sv
from spotweave.operators.scheduling import serve_overlays
from spotweave.plans.queries_placement import decided_overlays
from spotweave.plans.registry import query
from spotweave.session import fresh_path
from spotweave.sources import fixtures as fx
from spotweave.sources import sinks

DISPLAYS = (("tv", 1920, 1080), ("tablet", 1024, 768), ("phone", 640, 360), ("portrait", 360, 640))


@query("overlay_rows")
def q_overlay_rows(spark, d):
    rows = sv.overlay_rows(decided_overlays(spark, d).drop("item_id"), fx.ads(spark, d))
    return sv.with_urls(rows, "http://api").drop("resource_path")


@query("active_overlays")
def q_active(spark, d):
    playback = fx.playback(spark, d).withColumn("ended", F.expr("pos_ms >= 715000"))
    return sv.active_overlays(playback, decided_overlays(spark, d))


@query("overlay_layout")
def q_layout(spark, d):
    rows = fx.decisions(spark, d).selectExpr(
        "decision_id", "x", "y", "w", "h", "CASE WHEN decision_id % 29 = 0 THEN 0 ELSE 1280 END AS natural_w",
        "CASE WHEN decision_id % 31 = 0 THEN 0 ELSE 720 END AS natural_h",
        "CASE WHEN decision_id % 3 = 0 THEN NULL ELSE 100 + decision_id % 400 END AS ad_natural_w",
        "CASE WHEN decision_id % 3 = 0 THEN NULL ELSE 100 + (decision_id * 7) % 600 END AS ad_natural_h")
    laid = sv.overlay_layout(rows, DISPLAYS)
    return laid.select("decision_id", "display", *[F.round(c, 3).alias(c) for c in laid.columns[2:]])


@query("overlay_timeline")
def q_timeline(spark, d):
    rows = sv.overlay_timeline(decided_overlays(spark, d), fx.jobs(spark, d))
    return rows.withColumn("left_pct", F.round("left_pct", 6)).withColumn("width_pct", F.round("width_pct", 6))


@query("served_overlays")
def q_served(spark, d):
    return serve_overlays(decided_overlays(spark, d)).select(
        "job_id", "decision_id", "ad_id", "overlay_start_ms", "overlay_ms", "score")


@query("overlay_payload")
def q_payload(spark, d):
    """Served overlays as the player gets them."""
    served = serve_overlays(decided_overlays(spark, d))
    return sv.overlay_payload(served, fx.decisions(spark, d), fx.ads(spark, d), fx.job_files(spark, d), fx.jobs(spark, d), "http://api")


@query("decision_rows")
def q_decision_rows(spark, d):
    """Decision table after a run over all jobs and a rerun of a third of them that keeps less, for some jobs nothing."""
    path = fresh_path(spark, "decisions")
    rows = decided_overlays(spark, d).drop("item_id")
    sinks.write_run(rows, rows, path, 1)
    again = rows.filter("job_id % 3 = 0")
    sinks.write_run(again.filter("score >= 95"), again, path, 2)
    return sinks.read_runs(spark, path)


@query("job_status")
def q_job_status(spark, d):
    """State of the jobs named in the events."""
    wanted = fx.table(spark, d, "events").selectExpr("user_id * 3 AS job_id")
    return sv.job_status(fx.job_files(spark, d), wanted)


@query("completed_jobs")
def q_completed(spark, d):
    return sv.completed_jobs(fx.job_files(spark, d))


@query("placement_kpis")
def q_kpis(spark, d):
    """KPIs per ad and job group, from one table."""
    rows = fx.decisions(spark, d)
    per_job = sv.placement_kpis(rows, ["job_id"]).withColumn("level", F.lit("job")).withColumn(
        "key", F.col("job_id").cast("string")).drop("job_id")
    per_ad = sv.placement_kpis(rows, ["ad_id"]).withColumn("level", F.lit("ad")).withColumnRenamed("ad_id", "key")
    both = per_job.unionByName(per_ad)
    return both.select("level", "key", "n_overlays", F.round("mean_score", 6).alias("mean_score"),
                       F.round("mean_similarity", 6).alias("mean_similarity"))


@query("recommendation_strip")
def q_strip(spark, d):
    """Recommendation strip and the three collections."""
    done = sv.completed_jobs(fx.job_files(spark, d))
    strip = sv.recommendation_strip(done).withColumn("collection", F.lit("strip"))
    return strip.unionByName(sv.collections(done)).withColumn("slot", F.col("slot").cast("int"))


@query("job_diagnostics")
def q_diagnostics(spark, d):
    seen = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(
        F.min(F.col("ts").cast("timestamp_ntz")).alias("created_at"))
    jobs = fx.jobs(spark, d).select("job_id").join(seen, "job_id", "left")
    return sv.job_diagnostics(jobs, fx.jobs(spark, d), fx.transcript(spark, d))


@query("watch_progress")
def q_progress(spark, d):
    playback = fx.playback(spark, d)
    durations = fx.table(spark, d, "supplier").selectExpr("s_suppkey AS job_id", "720000L + s_suppkey * 0 AS duration_ms")
    return sv.watch_progress(playback, durations).withColumn("percent", F.round("percent", 6))
