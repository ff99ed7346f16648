"""Read models for players and dashboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.functions.text import ad_url, basename, format_time, source_url
from spotweave.operators.intervals import points_in
from spotweave.settings import DISPLAY, DisplaySettings


def overlay_rows(decisions: DataFrame, ads: DataFrame) -> DataFrame:
    """Decisions with their ad's type and path, in playing order."""
    known = ads.select("ad_id", "ad_type", "resource_path")
    return (decisions.join(known, "ad_id")
            .orderBy("job_id", "overlay_start_ms", F.desc("score"), "decision_id"))


def with_urls(rows: DataFrame, base: str) -> DataFrame:
    return rows.withColumn("ad_resource_url", ad_url(base, F.col("ad_type"), F.col("resource_path")))


def active_overlays(playback: DataFrame, overlays: DataFrame) -> DataFrame:
    """Overlay on screen at each playback position (event_id, job_id, pos_ms, ended).

    Start inclusive, end exclusive, none once ended; the best score wins, on ties the later one.
    """
    spans = overlays.select("job_id", "decision_id", "ad_id", "score", "overlay_start_ms",
                            (F.col("overlay_start_ms") + F.col("overlay_ms")).alias("overlay_end_ms"))
    shown = points_in(playback.filter(~F.col("ended")), spans, ["job_id"], "pos_ms",
                      "overlay_start_ms", "overlay_end_ms", end_open=True)
    best = F.max(F.struct("score", "overlay_start_ms", "decision_id", "ad_id")).alias("b")
    return shown.groupBy("event_id", "job_id", "pos_ms").agg(best).select(
        "event_id", "job_id", "pos_ms", "b.decision_id", "b.ad_id", "b.score")


def overlay_layout(overlays: DataFrame, displays: Sequence[tuple[str, int, int]],
                   cfg: DisplaySettings = DISPLAY) -> DataFrame:
    """Overlay rectangle on each display, as fixed box and fitted to the ad's own shape.

    ``overlays``: decision_id, x, y, w, h, natural_w, natural_h, ad_natural_w, ad_natural_h.
    """
    devices = F.array(*[F.struct(F.lit(name).alias("display"), F.lit(float(w)).alias("dw"), F.lit(float(h)).alias("dh"))
                        for name, w, h in displays])
    rows = overlays.withColumn("_d", F.explode(devices)).select("*", "_d.*").drop("_d")
    rows = rows.selectExpr(
        "*", "CASE WHEN natural_w > 0 THEN dw / natural_w ELSE 1D END AS sx",
        "CASE WHEN natural_h > 0 THEN dh / natural_h ELSE 1D END AS sy",
        f"dw * {cfg.max_share}D AS max_w", f"dh * {cfg.max_share}D AS max_h")
    rows = rows.selectExpr(
        "*", "coalesce(x * sx, 0D) AS rx", "coalesce(y * sy, 0D) AS ry",
        f"CASE WHEN w > 0 THEN w * sx ELSE dw * {cfg.default_width_share}D END AS rw",
        f"CASE WHEN h > 0 THEN h * sy ELSE dh * {cfg.default_height_share}D END AS rh")
    rows = rows.selectExpr(
        "*", "least(rw, max_w) AS box_w", "least(rh, max_h) AS box_h",
        "coalesce(CAST(ad_natural_w AS DOUBLE), rw) AS nw", "coalesce(CAST(ad_natural_h AS DOUBLE), rh) AS nh")
    rows = rows.selectExpr(
        "*", "least(rx, dw - box_w) AS box_x", "least(ry, dh - box_h) AS box_y", "nh > nw AS portrait",
        "CASE WHEN nw > 0 AND nh > 0 THEN nw / nh ELSE rw / rh END AS aspect")
    rows = rows.selectExpr(
        "*", "CASE WHEN portrait THEN least(nh * sy, max_h) * aspect "
        "WHEN least(nw * sx, max_w) / aspect > max_h THEN max_h * aspect ELSE least(nw * sx, max_w) END AS fit_w",
        "CASE WHEN portrait THEN least(nh * sy, max_h) "
        "WHEN least(nw * sx, max_w) / aspect > max_h THEN max_h ELSE least(nw * sx, max_w) / aspect END AS fit_h")
    return rows.selectExpr(
        "decision_id", "display", "box_x", "box_y", "box_w", "box_h",
        f"CASE WHEN portrait AND rx < dw / 2 THEN {float(cfg.side_margin)}D "
        f"WHEN portrait THEN dw - fit_w - {cfg.side_margin} ELSE least(rx, dw - fit_w) END AS fit_x",
        f"dh - fit_h - {cfg.bottom_margin} AS fit_y", "fit_w", "fit_h")


def score_band(score: Column, cfg: DisplaySettings = DISPLAY) -> Column:
    return (F.when(score >= cfg.good_score, F.lit("good")).when(score >= cfg.fair_score, F.lit("fair"))
            .otherwise(F.lit("low")))


def overlay_timeline(overlays: DataFrame, info: DataFrame, cfg: DisplaySettings = DISPLAY) -> DataFrame:
    """Position and width in percent of the video, time label and score band."""
    known = info.select("job_id", "duration_ms")
    rows = overlays.join(known, "job_id", "left")
    total = F.when(F.col("duration_ms") > 0, F.col("duration_ms") / 1000).otherwise(F.lit(1.0))
    start, length = F.col("overlay_start_ms") / 1000, F.col("overlay_ms") / 1000
    return rows.select(
        "job_id", "decision_id", "ad_id", (start / total * 100).alias("left_pct"),
        F.greatest(F.lit(cfg.min_width_pct), length / total * 100).alias("width_pct"),
        format_time(start).alias("time_label"), score_band(F.col("score"), cfg).alias("band"))


def completed_jobs(jobs: DataFrame, hidden: str = "samplevideo") -> DataFrame:
    """Finished jobs, newest first, without the sample videos."""
    done = jobs.filter("status = 'complete'").select(
        "job_id", basename(F.col("video_path")).alias("filename"), "updated_at")
    return (done.filter(~F.contains(F.lower("filename"), F.lit(hidden)))
            .orderBy(F.desc("updated_at"), "job_id"))


def job_status(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """State of each asked-for job (job_id); ``found`` is false where there is no such job."""
    known = jobs.select("job_id", "status", "video_path", "updated_at", F.lit(True).alias("found"))
    return wanted.select("job_id").distinct().join(known, "job_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def overlay_payload(served: DataFrame, decisions: DataFrame, ads: DataFrame, jobs: DataFrame, info: DataFrame, base: str) -> DataFrame:
    """What a player needs, one row per served overlay: ad type and URL, rectangle, times, and the job's video URL and duration.

    ``served``: decision_id, job_id, ad_id, overlay_start_ms, overlay_ms, score; ``decisions``: decision_id, x, y, w, h; ``jobs``: job_id,
    video_path; ``info``: job_id, duration_ms. Jobs without a video or a duration are not served.
    """
    rows = (served.join(decisions.select("decision_id", "x", "y", "w", "h"), "decision_id")
            .join(ads.select("ad_id", "ad_type", "resource_path"), "ad_id")
            .join(jobs.select("job_id", "video_path"), "job_id").join(info.select("job_id", "duration_ms"), "job_id"))
    seconds = lambda ms: (F.col(ms) / 1000).alias(ms.replace("_ms", "_sec"))
    return with_urls(rows, base).select(
        "job_id", source_url(base, F.col("video_path")).alias("video_url"), seconds("duration_ms"), "decision_id", "ad_id", "ad_type",
        "ad_resource_url", seconds("overlay_start_ms"), seconds("overlay_ms"), "x", "y", "w", "h", "score")


def placement_kpis(decisions: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlays, mean score and mean similarity per job or ad (exact sums)."""
    return decisions.groupBy(*by).agg(
        F.count("*").alias("n_overlays"), (F.sum("score") / F.count("score")).alias("mean_score"),
        (F.sum("similarity_e3") / F.count("similarity_e3") / 1000).alias("mean_similarity"))


def _ends(completed: DataFrame, size: int) -> DataFrame:
    """The first and last ``size`` listed jobs with their distance from either end."""
    first = completed.orderBy(F.desc("updated_at"), "job_id").limit(size)
    last = completed.orderBy("updated_at", F.desc("job_id")).limit(size)
    rank = F.expr("row_number() OVER (ORDER BY updated_at DESC, job_id)")
    back = F.expr("row_number() OVER (ORDER BY updated_at, job_id DESC)")
    return (first.withColumn("pos", rank).withColumn("side", F.lit("front"))
            .unionByName(last.withColumn("pos", back).withColumn("side", F.lit("back"))))


def recommendation_strip(completed: DataFrame, size: int = 10) -> DataFrame:
    """The listing reversed, then the listing itself, first ``size`` entries (a top-k report)."""
    ends = _ends(completed, size).withColumn("part", F.when(F.col("side") == "back", 0).otherwise(1))
    return (ends.withColumn("slot", F.expr("row_number() OVER (ORDER BY part, pos)"))
            .filter(F.col("slot") <= size).select("slot", "job_id", "filename"))


def collections(completed: DataFrame) -> DataFrame:
    """Three five-item selections: the front, the back reversed, and positions 3 to 7."""
    ends = _ends(completed, 7)
    front, back = F.col("side") == "front", F.col("side") == "back"
    picks = (ends.filter(front & (F.col("pos") <= 5)).withColumn("collection", F.lit("A"))
             .unionByName(ends.filter(back & (F.col("pos") <= 5)).withColumn("collection", F.lit("B")))
             .unionByName(ends.filter(front & (F.col("pos") > 2)).withColumn("pos", F.col("pos") - 2)
                          .withColumn("collection", F.lit("C"))))
    return picks.select("collection", F.col("pos").alias("slot"), "job_id", "filename")


def job_diagnostics(jobs: DataFrame, info: DataFrame, segments: DataFrame) -> DataFrame:
    """Duration and number of segments per job, the latest job flagged."""
    counts = segments.groupBy("job_id").agg(F.count("*").alias("n_segments"))
    latest = jobs.agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("j")).select("j").scalar()
    return (jobs.join(info.select("job_id", "duration_ms"), "job_id").join(counts, "job_id", "left")
            .select("job_id", "duration_ms", F.coalesce("n_segments", F.lit(0).cast("long")).alias("n_segments"),
                    (F.col("job_id") == latest).alias("is_latest")))


def watch_progress(playback: DataFrame, durations: DataFrame, done_pct: float = 98.0) -> DataFrame:
    """Latest position per (viewer, job), percent watched and whether it can be resumed."""
    latest = playback.groupBy("viewer_id", "job_id").agg(
        F.max(F.struct("ts", "event_id", "pos_ms")).alias("p"))
    rows = latest.select("viewer_id", "job_id", "p.pos_ms", F.col("p.ts").alias("updated_at")).join(durations.select("job_id", "duration_ms"), "job_id")
    percent = F.col("pos_ms") / F.col("duration_ms") * 100
    return rows.filter("duration_ms > 0").select(
        "viewer_id", "job_id", "pos_ms", percent.alias("percent"), "updated_at",
        ((F.col("pos_ms") > 0) & (percent < done_pct)).alias("resumable"))
