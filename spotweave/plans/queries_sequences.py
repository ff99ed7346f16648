"""Interval, sampling, audio and frame-feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import audio, frames as fr
from spotweave.operators.intervals import overlapping, points_in
from spotweave.operators.ordered import span_chunk
from spotweave.operators.segments import ordered_text
from spotweave.plans.fixture_plan import fixture_plan
from spotweave.plans.registry import query
from spotweave.sources import fixtures as fx


def _spans(spark, d):
    return fixture_plan(spark, d).scenes().select("job_id", F.col("start_ms").alias("scene_start"),
                                                  F.col("end_ms").alias("scene_end"))


@query("frames_in_scene")
def q_frames_in_scene(spark, d):
    return points_in(fx.frame_times(spark, d), _spans(spark, d), ["job_id"], "ts_ms", "scene_start", "scene_end")


@query("scene_transcript")
def q_scene_transcript(spark, d):
    """Whole transcript of each scene and the excerpt handed to the description step."""
    spans = _spans(spark, d)
    said = points_in(fx.transcript(spark, d), spans, ["job_id"], "start_ms", "scene_start", "scene_end", end_open=True)
    said = said.withColumn("_chunk", span_chunk("start_ms", 600_000))
    texts = ordered_text(said, ["job_id", "scene_start"], "_chunk", ["start_ms", "seg_id"], "text")
    joined = spans.join(texts, ["job_id", "scene_start"], "left")
    text = F.trim(F.coalesce("transcript", F.lit("")))
    return joined.select("job_id", "scene_start", text.alias("transcript"), F.substring(text, 1, 1200).alias("excerpt"))


@query("interval_overlap")
def q_interval_overlap(spark, d):
    """Speech and silence overlapping each scene."""
    spans = _spans(spark, d)
    speech = fx.transcript(spark, d).selectExpr("job_id", "'speech' AS kind", "start_ms", "end_ms")
    quiet = fx.silence(spark, d).selectExpr("job_id", "'silence' AS kind", "start_ms", "end_ms")
    return overlapping(speech.unionByName(quiet), spans, ["job_id"], ("start_ms", "end_ms"), ("scene_start", "scene_end"))


@query("sampled_frames")
def q_sampled(spark, d):
    return fr.sampled_frames(fixture_plan(spark, d).scenes(), fx.jobs(spark, d))


@query("stride_samples")
def q_stride(spark, d):
    return fr.stride_samples(fx.frame_times(spark, d))


@query("rms_levels")
def q_rms(spark, d):
    samples = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey DIV 1000 AS job_id", "o_orderkey % 1000 AS i", "(o_orderkey * 7919) % 2001 - 1000 AS x")
    return audio.rms_levels(samples, sample_rate=400).select("job_id", "tick", F.round("rms", 6).alias("rms"))


@query("silence_intervals")
def q_silence(spark, d):
    levels = fx.table(spark, d, "orders").selectExpr(
        "o_orderkey DIV 500 AS job_id", "o_orderkey % 500 AS tick",
        "CAST(CASE WHEN (o_orderkey DIV 7) % 3 = 0 THEN (o_orderkey * 31) % 12 "
        "ELSE 500 + (o_orderkey * 17) % 500 END AS DOUBLE) AS rms")
    tracks = levels.groupBy("job_id").agg((F.count("*") * 250 + 100).alias("track_ms"))
    return audio.silence_intervals(levels, tracks, hop_ms=250)


@query("frame_density")
def q_frame_density(spark, d):
    boxes = fx.detections(spark, d)
    return fr.frame_density(boxes, fr.kept_detections(boxes), 1280, 720)


@query("safe_area")
def q_safe_area(spark, d):
    boxes = fx.detections(spark, d)
    return fr.safe_area(boxes, boxes.filter("confidence_pct >= 35"), 1280, 720)


@query("cut_flags")
def q_cuts(spark, d):
    signals = fx.table(spark, d, "embeddings").selectExpr(
        "vec_id DIV 50 AS job_id", "vec_id AS frame_index", "transform(embedding, x -> x * 255D) AS signal")
    return fr.cut_flags(signals)


@query("frame_features")
def q_frame_features(spark, d):
    """Everything known of every frame, from its detections and its signal."""
    boxes = fx.detections(spark, d)
    return fr.frame_features(boxes, boxes, fx.frame_signals(spark, d), fx.jobs(spark, d), 1280, 720,
                             shared=fx.shared_signals(spark, d))
