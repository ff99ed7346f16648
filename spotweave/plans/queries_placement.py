"""Scenes, matching, placement and scheduling queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.operators import candidates as cand
from spotweave.operators import placement as place
from spotweave.operators import scheduling as sched
from spotweave.operators.segments import scene_numbers, scene_segments, scene_texts
from spotweave.operators.similarity import category_bonus, pair_similarity, with_ids
from spotweave.plans.fixture_plan import SETTINGS, fixture_plan
from spotweave.plans.registry import query
from spotweave.sources import fixtures as fx


def _r6(col: str) -> Column:
    return F.round(col, 6).alias(col)


@query("scene_segments")
def q_scene_segments(spark: SparkSession, d: str) -> DataFrame:
    """Scenes with their whole spoken text."""
    segments, vectors = fx.transcript(spark, d), fx.vectors(spark, d)
    numbered = scene_numbers(segments, vectors, SETTINGS.segmentation)
    scenes = scene_segments(segments, vectors, fx.jobs(spark, d), SETTINGS.segmentation, numbered)
    texts = scene_texts(numbered, SETTINGS.segmentation)
    return scenes.join(texts, ["job_id", "scene_no"], "left").withColumn(
        "transcript", F.coalesce("transcript", F.lit("")))


@query("candidates")
def q_candidates(spark, d):
    """Scene x ad pairs per job, and how many of them physically fit."""
    return cand.candidate_volume(fixture_plan(spark, d).scenes(), fx.ads(spark, d))


@query("scene_objects")
def q_scene_objects(spark, d):
    return cand.scene_objects(fixture_plan(spark, d).scenes(), fx.frames(spark, d, "objects")).select(
        "job_id", "start_ms", "end_ms", "objects")


@query("brand_safety")
def q_brand_safety(spark, d):
    """Unsafe keyword, if any, of every document."""
    flagged = cand.brand_safety(fx.table(spark, d, "documents"), "text", fx.FIXTURE_SAFETY_WORDS)
    return flagged.select("doc_id", "unsafe_word")


@query("category_gate")
def q_category_gate(spark, d):
    """Restricted ads per gate state of the documents."""
    texts = cand.category_gate(fx.table(spark, d, "documents"), "text", fx.FIXTURE_GATE_WORDS)
    gated = fx.ads(spark, d).agg(F.count(F.when(
        cand.restricted(F.col("ad_category_path"), fx.FIXTURE_GATE_TAG), 1)).alias("n")).select("n").scalar()
    return texts.select("doc_id", "gate_open", F.when(F.col("gate_open"), F.lit(0).cast("long"))
                        .otherwise(gated).alias("blocked_ads"))


@query("scene_thresholds")
def q_scene_thresholds(spark, d):
    scenes = cand.scene_objects(fixture_plan(spark, d).scenes(), fx.frames(spark, d, "objects"))
    length = F.col("end_ms") - F.col("start_ms")
    return scenes.select("job_id", "start_ms", cand.sim_threshold(
        length, F.col("objects"), SETTINGS.matching).alias("threshold"))


@query("ad_size_tiers")
def q_ad_size_tiers(spark, d):
    w, h = place.reference_size(F.col("ad_type"))
    size = place.normalized_size(F.col("width"), F.col("height"), w, h)
    return fx.ads(spark, d).withColumn("size", size).select(
        "ad_id", F.col("size.w").alias("ad_w"), F.col("size.h").alias("ad_h"), F.col("size").isNull().alias("dropped"))


@query("pair_similarity")
def q_pair_similarity(spark, d):
    vectors = fx.vectors(spark, d)
    targets = with_ids(fx.ads(spark, d), vectors.select(F.col("vec_id").alias("tgt_vec"), F.col("embedding").alias("tgt_emb")))
    pairs = pair_similarity(vectors, targets, SETTINGS.matching.lowest)
    return pairs.select("ctx_vec", "ad_id", _r6("sim"))


@query("blended_similarity")
def q_blended_similarity(spark, d):
    """Blended similarity of every distinct scene context and ad above the lowest threshold."""
    return fixture_plan(spark, d).matched_pairs().select("ctx_vec", "desire_vec", "ad_id", _r6("sim"))


@query("category_bonus")
def q_category_bonus(spark, d):
    vectors = fx.vectors(spark, d)
    cats = fx.category_vectors(spark, d).withColumnRenamed("cat_vec", "vec_id").join(vectors, "vec_id")
    return category_bonus(vectors, cats.select("ad_category", "embedding"),
                          SETTINGS.placement.category_points, SETTINGS.matching)


@query("prefilter")
def q_prefilter(spark, d):
    """Ads each scene admits: how many, the best and the mean similarity."""
    return fixture_plan(spark, d).admitted().select(
        "job_id", "start_ms", "n_kept", _r6("best_sim"), F.round(F.col("sim_sum") / F.col("n_kept"), 6).alias("mean_sim"))


@query("topk_per_scene")
def q_topk(spark, d):
    return fixture_plan(spark, d).top_similar().select(
        "job_id", "start_ms", F.col("rank").cast("int").alias("rank"), "ad_id", _r6("sim"))


@query("rerank_top3")
def q_rerank(spark, d):
    return fixture_plan(spark, d).reranked().select(
        "job_id", "start_ms", F.col("rerank").cast("int").alias("rerank"), "ad_id", _r6("sim"), _r6("pair_score"))


@query("placement_windows")
def q_windows(spark, d):
    """Windows of each candidate: number, first and last start."""
    rows = place.placement_windows(fixture_plan(spark, d).planned())
    return rows.select("job_id", "start_ms", "ad_id", "n_windows", "first_start_ms", "last_start_ms")


def _windows(condition: Column) -> Column:
    """Number of single windows in the pieces that meet the condition."""
    return F.sum(F.when(condition, F.col("n_windows")).otherwise(F.lit(0)))


_PER_REQUEST = ("job_id", "start_ms", "window_ms", "ad_w")


def _density(features: DataFrame) -> DataFrame:
    p = SETTINGS.placement
    danger = F.col("density_sum") >= p.danger_density_e4 * F.col("frames")
    golden = F.col("density_sum") <= p.golden_density_e4 * F.col("frames")
    return features.groupBy(*_PER_REQUEST).agg(
        F.sum("n_windows").alias("windows"), _windows(danger).alias("n_danger"), _windows(golden).alias("n_golden"),
        F.sum(F.col("density_sum") * F.col("n_windows")).alias("density_sum"),
        F.sum(F.col("frames") * F.col("n_windows")).alias("n_frames")).withColumnRenamed("windows", "n_windows")


def _corners(features: DataFrame) -> DataFrame:
    return place.corner_choice(features).groupBy(*_PER_REQUEST).agg(
        _windows(F.col("corner") == "BL").alias("n_bl"), _windows(F.col("corner") == "BR").alias("n_br"),
        _windows(F.col("corner").isNull()).alias("n_none"),
        F.sum(F.col("overlap_sum") * F.col("n_windows")).alias("overlap_sum"))


@query("window_density")
def q_density(spark, d):
    """Density classes of the windows of each request."""
    return _density(fixture_plan(spark, d).features())


@query("best_corner")
def q_corner(spark, d):
    return _corners(fixture_plan(spark, d).features())


@query("detected_density")
def q_detected_density(spark, d):
    """Density classes of the windows where frame features come from detections."""
    return _density(fixture_plan(spark, d, detected=True).features())


@query("detected_corner")
def q_detected_corner(spark, d):
    return _corners(fixture_plan(spark, d, detected=True).features())


@query("window_silence")
def q_window_silence(spark, d):
    f = fixture_plan(spark, d).features()
    return f.groupBy(*_PER_REQUEST).agg(F.sum("n_windows").alias("windows"), _windows(F.col("quiet") == 1).alias("n_quiet")
                                        ).withColumnRenamed("windows", "n_windows")


@query("scored_candidates")
def q_scored(spark, d):
    return fixture_plan(spark, d).scored().select(
        "job_id", "start_ms", "ad_id", "score", _r6("sim"), _r6("avg_density"), "overlay_start_ms", "overlay_ms",
        "x", "y", "w", "h", "corner", "safe_px", "quiet")


_OVERLAY = ["job_id", "start_ms", "ad_id", "score", "overlay_start_ms", "overlay_ms"]


@query("best_per_scene")
def q_best_per_scene(spark, d):
    return sched.best_per_scene(fixture_plan(spark, d).scored()).select(*_OVERLAY)


def decided_overlays(spark: SparkSession, d: str) -> DataFrame:
    """Decision rows in the shape the scheduling rules take."""
    return fx.decisions(spark, d).select(
        "job_id", F.col("decision_id").alias("item_id"), "decision_id", "ad_id",
        F.col("start_ms").alias("overlay_start_ms"), F.col("duration_ms").alias("overlay_ms"), "score")


def _decision_cols(df: DataFrame) -> DataFrame:
    return df.select("job_id", "decision_id", "ad_id", "overlay_start_ms", "overlay_ms", "score")


@query("schedule_overlaps")
def q_overlaps(spark, d):
    rows = decided_overlays(spark, d).withColumn("item_id", F.lpad(F.col("item_id").cast("string"), 12, "0"))
    return _decision_cols(sched.drop_overlaps(rows))


@query("cold_zones")
def q_cold(spark, d):
    return _decision_cols(sched.cold_zones(decided_overlays(spark, d), fx.jobs(spark, d)))


@query("schedule_spacing")
def q_spacing(spark, d):
    rows = decided_overlays(spark, d).withColumn("item_id", F.lpad(F.col("item_id").cast("string"), 12, "0"))
    return _decision_cols(sched.space_out(rows, fx.jobs(spark, d)))


@query("schedule_unique")
def q_unique(spark, d):
    return _decision_cols(sched.unique_ads(decided_overlays(spark, d)))


def _scheduled(plan) -> DataFrame:
    return plan.schedule().select(*_OVERLAY, _r6("sim"), _r6("avg_density"), "x", "y", "w", "h", "corner", "quiet")


@query("ad_schedule")
def q_schedule(spark, d):
    return _scheduled(fixture_plan(spark, d))


@query("detected_schedule")
def q_detected_schedule(spark, d):
    """The schedule from detections to placed overlays."""
    return _scheduled(fixture_plan(spark, d, detected=True))
