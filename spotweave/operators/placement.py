"""Sliding placement windows and candidate scores.

Window features depend on (scene, window length, ad size) only, so they are computed once per
such *request* and shared by all ads. A frame, a speech gap or a silence touches a range of
consecutive windows; only the two ends of each range become rows. Running sums over these ends
give *pieces*: runs of windows with equal features. Single windows are never enumerated, and a
request is cut into chunks of windows, each with its own opening balance, so that an endless
scene is many independent groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.intervals import overlapping, points_in
from spotweave.operators.ordered import running_max_before, span_chunk
from spotweave.session import stage
from spotweave.settings import MATCHING, PLACEMENT, MatchSettings, PlacementSettings

REQUEST = ["job_id", "start_ms", "window_ms", "ad_w", "ad_h"]


def normalized_size(w: Column, h: Column, ref_w: Column, ref_h: Column,
                    cfg: PlacementSettings = PLACEMENT) -> Column:
    """STRUCT<w, h> after the three size tiers; NULL when the ad is too far off."""
    def within(pct: int) -> Column:
        return ((F.abs(w - ref_w) * 100 <= ref_w * pct) & (F.abs(h - ref_h) * 100 <= ref_h * pct))

    reference = F.struct(ref_w.cast("int").alias("w"), ref_h.cast("int").alias("h"))
    missing = w.isNull() | h.isNull() | (w <= 0) | (h <= 0)
    return (F.when(missing, reference)
            .when(within(cfg.keep_size_pct), F.struct(w.cast("int").alias("w"), h.cast("int").alias("h")))
            .when(within(cfg.snap_size_pct), reference))


def reference_size(ad_type: Column, cfg: PlacementSettings = PLACEMENT) -> tuple[Column, Column]:
    clip = ad_type == "video_clip"
    return (F.when(clip, cfg.clip_size[0]).otherwise(cfg.banner_size[0]),
            F.when(clip, cfg.clip_size[1]).otherwise(cfg.banner_size[1]))


def with_window_plan(candidates: DataFrame, cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Add window_ms, last_window (highest window number) and overlay_ms; drop what cannot fit."""
    scene = F.col("end_ms") - F.col("start_ms")
    clip = F.col("ad_type") == "video_clip"
    fixed = clip & F.col("ad_ms").isNotNull()
    shown = F.coalesce(F.when(F.col("ad_ms") != 0, F.col("ad_ms")), F.lit(cfg.banner_ms))
    planned = (candidates.filter(~fixed | (scene >= F.col("ad_ms")))
               .withColumn("window_ms", F.when(fixed, F.col("ad_ms")).otherwise(
                   F.least(F.coalesce("ad_ms", F.lit(cfg.banner_ms)), scene)).cast("long"))
               .withColumn("overlay_ms", F.when(clip, shown).otherwise(F.least(shown, scene)).cast("long")))
    room = F.col("end_ms") + cfg.overrun_ms - F.col("start_ms") - F.col("window_ms")
    return (planned.withColumn("last_window", F.floor(room / cfg.step_ms).cast("long"))
            .filter(F.col("last_window") >= 0))


def window_requests(planned: DataFrame) -> DataFrame:
    return planned.select(*REQUEST, "end_ms", "last_window").distinct()


def placement_windows(planned: DataFrame, cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Add n_windows, first_start_ms and last_start_ms of every candidate: windows start every ``step_ms``."""
    return (planned.withColumn("n_windows", F.col("last_window") + 1).withColumn("first_start_ms", F.col("start_ms"))
            .withColumn("last_start_ms", F.col("start_ms") + F.col("last_window") * cfg.step_ms))


def speech_gaps(segments: DataFrame, info: DataFrame, chunk_ms: int = 600_000) -> DataFrame:
    """Stretches of a job without speech, from 0 to just past the end of the video."""
    before = running_max_before(segments.select("job_id", "seg_id", "start_ms", "end_ms"), ["job_id"],
                                span_chunk("start_ms", chunk_ms), ["start_ms", "seg_id"], "end_ms", "spoken_ms")
    inner = before.select("job_id", F.coalesce("spoken_ms", F.lit(0)).alias("gap_start"),
                          F.col("start_ms").alias("gap_end"))
    last = segments.groupBy("job_id").agg(F.max("end_ms").alias("gap_start"))
    tail = last.join(info.select("job_id", "duration_ms"), "job_id", "left").select(
        "job_id", "gap_start", (F.greatest("gap_start", "duration_ms") + 1).alias("gap_end"))
    return inner.unionByName(tail).filter(F.col("gap_end") > F.col("gap_start"))


def _corner_overlap(corner_x: Column, corner_y: Column) -> Column:
    across = (F.least(corner_x + F.col("ad_w"), F.col("safe_x") + F.col("safe_w"))
              - F.greatest(corner_x, F.col("safe_x")))
    down = (F.least(corner_y + F.col("ad_h"), F.col("safe_y") + F.col("safe_h"))
            - F.greatest(corner_y, F.col("safe_y")))
    return F.greatest(F.lit(0), across).cast("long") * F.greatest(F.lit(0), down)


def _window_no(position: Column, rounding, cfg: PlacementSettings) -> Column:
    return rounding((position - F.col("start_ms")) / F.lit(cfg.step_ms)).cast("long")


_EMPTY = {"frames": 0, "density_sum": 0, "safe_frames": 0, "bl_sum": 0, "br_sum": 0, "quiet": 0}


def _range_ends(touching: DataFrame, first_ms: Column, last_ms: Column, cfg: PlacementSettings,
                **values: Column) -> DataFrame:
    """Changes of the sums where windows starting in [first_ms, last_ms] begin and end.

    A range crossing into a further chunk is opened again there.
    """
    low = F.greatest(F.lit(0).cast("long"), _window_no(first_ms, F.ceil, cfg))
    high = F.least(F.col("last_window"), _window_no(last_ms, F.floor, cfg))
    filled = {name: values.get(name, F.lit(zero)).cast("long") for name, zero in _EMPTY.items()}
    ranges = touching.select(*REQUEST, "last_window", low.alias("_low"), high.alias("_high"),
                             *[v.alias(n) for n, v in filled.items()]).filter("_low <= _high")
    size = cfg.chunk_windows
    ends = (ranges.withColumn("chunk", F.expr(f"explode(sequence(_low DIV {size}, _high DIV {size}))"))
            .withColumn("_sign", F.explode(F.array(F.lit(1), F.lit(-1))))
            .withColumn("k", F.expr(f"CASE WHEN _sign = 1 THEN greatest(_low, chunk * {size}) ELSE _high + 1 END"))
            .filter(f"_sign = 1 OR (k < (chunk + 1) * {size} AND k <= last_window)"))
    return ends.select(*REQUEST, "last_window", "chunk", "k", *[(F.col(n) * F.col("_sign")).alias(n) for n in _EMPTY])


def frame_windows(requests: DataFrame, frames: DataFrame, info: DataFrame,
                  cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """What each frame adds to the windows it lies in: density and safe-area overlap per corner."""
    touching = points_in(frames.select("job_id", "ts_ms", "safe_x", "safe_y", "safe_w", "safe_h", "density_e4"),
                         requests, ["job_id"], "ts_ms", "start_ms", "end_ms", bucket_ms=cfg.bucket_ms)
    touching = touching.join(info.select("job_id", F.col("width").alias("_vw"), F.col("height").alias("_vh")), "job_id", "left")
    sized = (F.col("_vw") > 0) & (F.col("_vh") > 0)
    wide = F.when(sized, F.col("_vw")).otherwise(F.lit(cfg.default_frame[0]))
    high = F.when(sized, F.col("_vh")).otherwise(F.lit(cfg.default_frame[1]))
    bottom = high - F.col("ad_h") - cfg.edge_px
    usable = F.coalesce((F.col("safe_w") > 0) & (F.col("safe_h") > 0), F.lit(False))
    scored = (touching
              .withColumn("bl", F.when(usable, _corner_overlap(F.lit(cfg.edge_px), bottom)).otherwise(F.lit(0)))
              .withColumn("br", F.when(usable, _corner_overlap(wide - F.col("ad_w") - cfg.edge_px, bottom))
                          .otherwise(F.lit(0)))
              .withColumn("usable", usable)
              .select(*REQUEST, "last_window", "ts_ms", "density_e4", "bl", "br", "usable"))
    return _range_ends(scored, F.col("ts_ms") - F.col("window_ms"), F.col("ts_ms"), cfg, frames=F.lit(1),
                       density_sum=F.coalesce("density_e4", F.lit(0)), safe_frames=F.col("usable").cast("int"),
                       bl_sum=F.col("bl"), br_sum=F.col("br"))


def quiet_windows(requests: DataFrame, segments: DataFrame, silence: DataFrame, info: DataFrame,
                  cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Ranges of windows that pass the silence test (they may overlap).

    Jobs with a transcript need a speech gap of ``quiet_gap_ms`` inside the window, or no speech
    in it at all; a gap that runs past the scene counts as lasting to the window's end. Jobs
    without one need an overlapping silence.
    """
    spans = requests.select(*REQUEST, "end_ms", "last_window")
    gaps = overlapping(stage(speech_gaps(segments, info), "speech-gaps"), spans, ["job_id"],
                       ("gap_start", "gap_end"), ("start_ms", "end_ms"), cfg.bucket_ms)
    need = F.least(F.lit(cfg.quiet_gap_ms).cast("long"), F.col("window_ms"))
    runs_on = F.col("gap_end") >= F.col("end_ms")
    gaps = gaps.filter(runs_on | (F.col("gap_end") - F.col("gap_start") >= need))
    from_gaps = _range_ends(gaps, F.col("gap_start") + need - F.col("window_ms"),
                            F.when(runs_on, F.col("end_ms") + cfg.overrun_ms).otherwise(F.col("gap_end") - need),
                            cfg, quiet=F.lit(1))
    unspoken = silence.join(segments.select("job_id").distinct(), "job_id", "left_anti").select(
        "job_id", F.col("start_ms").alias("sil_start"), F.col("end_ms").alias("sil_end"))
    hits = overlapping(unspoken, spans, ["job_id"], ("sil_start", "sil_end"), ("start_ms", "end_ms"), cfg.bucket_ms)
    from_silence = _range_ends(hits, F.col("sil_start") - F.col("window_ms") + 1, F.col("sil_end") - 1, cfg,
                               quiet=F.lit(1))
    return from_gaps.unionByName(from_silence)


def window_features(requests: DataFrame, frames: DataFrame, segments: DataFrame, silence: DataFrame,
                    info: DataFrame, cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Pieces of equal windows that have frames: windows ``k`` to ``k + n_windows - 1`` share frame
    count, density sum, corner overlap sums and quiet flag."""
    group = [*REQUEST, "chunk", "last_window"]

    def changes(ends: DataFrame) -> DataFrame:
        # Combines before the shuffle: many frames begin or end the same window.
        return ends.groupBy(*group, "k").agg(*[F.sum(c).alias(c) for c in _EMPTY])

    # Each range join is a query of its own: the driver holds the plan of one at a time.
    quiet = stage(changes(quiet_windows(requests, segments, silence, info, cfg)), "quiet-windows")
    steps = changes(stage(changes(frame_windows(requests, frames, info, cfg)), "frame-windows").unionByName(quiet))
    ordered = Window.partitionBy(*group).orderBy("k")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.least(F.coalesce(F.lead("k").over(ordered), F.col("last_window") + 1),
                    (F.col("chunk") + 1) * cfg.chunk_windows)
    pieces = steps.select(*REQUEST, "k", (until - F.col("k")).alias("n_windows"),
                          *[F.sum(c).over(so_far).alias(c) for c in _EMPTY])
    return pieces.filter("frames > 0").withColumn("quiet", (F.col("quiet") > 0).cast("int"))


def corner_choice(features: DataFrame, cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Add corner (BL, or BR when strictly better; NULL when too little of the ad is visible)."""
    best = F.greatest("bl_sum", "br_sum")
    enough = (F.col("safe_frames") > 0) & (best > 0) & (
        best >= F.lit(cfg.min_visible_share) * F.col("ad_w") * F.col("ad_h") * F.col("safe_frames"))
    side = F.when(F.col("bl_sum") >= F.col("br_sum"), F.lit("BL")).otherwise(F.lit("BR"))
    return features.withColumn("corner", F.when(enough, side)).withColumn("overlap_sum", best)


def best_windows(features: DataFrame, cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Best window per request: most points, then earliest. What an ad adds to the score is the
    same in all its windows, so it cannot change the choice."""
    usable = corner_choice(features, cfg).filter(
        F.col("corner").isNotNull() & (F.col("density_sum") < cfg.danger_density_e4 * F.col("frames")))
    golden = (F.col("density_sum") <= cfg.golden_density_e4 * F.col("frames")).cast("int")
    points = golden * cfg.golden_points + F.col("quiet") * cfg.silence_points
    best = usable.groupBy(*REQUEST).agg(F.max(F.struct(
        points.cast("int").alias("points"), (-F.col("k")).alias("minus_k"), "frames", "density_sum",
        "corner", "overlap_sum", "safe_frames", "quiet")).alias("b"))
    return best.select(*REQUEST, "b.points", (-F.col("b.minus_k")).alias("k"), "b.frames", "b.density_sum",
                       "b.corner", "b.overlap_sum", "b.safe_frames", "b.quiet")


def start_delay(scene_ms: Column, cfg: PlacementSettings = PLACEMENT) -> Column:
    longest, *rest = cfg.start_delays
    delay = F.when(scene_ms >= longest[0], F.lit(longest[1]))
    for at_least, wait in rest:
        delay = delay.when(scene_ms >= at_least, F.lit(wait))
    return delay


def score_candidates(planned: DataFrame, best: DataFrame, info: DataFrame,
                     match: MatchSettings = MATCHING, cfg: PlacementSettings = PLACEMENT) -> DataFrame:
    """Scored overlays: planned candidates (with ``sim``, ``threshold``, ``category_bonus``,
    ``unsafe_word``) at their best window. Unsafe scenes and zero scores drop out."""
    joined = planned.filter(F.col("unsafe_word").isNull()).join(best, REQUEST)
    scaled = (F.col("sim") - F.col("threshold")) / (F.lit(1.0) - F.col("threshold"))
    semantic = F.when(F.col("sim") >= F.col("threshold"),
                      F.floor(scaled * cfg.semantic_points)).otherwise(F.lit(0))
    scored = joined.withColumn(
        "score", (semantic + F.col("category_bonus") + F.col("points")).cast("long")).filter(F.col("score") > 0)
    scene_ms = F.col("end_ms") - F.col("start_ms")
    scored = scored.join(info.select("job_id", F.col("width").alias("_vw"), F.col("height").alias("_vh")), "job_id", "left")
    sized = (F.col("_vw") > 0) & (F.col("_vh") > 0)
    wide = F.when(sized, F.col("_vw")).otherwise(F.lit(cfg.default_frame[0]))
    high = F.when(sized, F.col("_vh")).otherwise(F.lit(cfg.default_frame[1]))
    return scored.select(
        "job_id", "start_ms", "end_ms", "ad_id", "score", "sim",
        scene_ms.cast("long").alias("scene_ms"),
        (F.col("density_sum") / F.col("frames") / 10_000).alias("avg_density"),
        (F.col("start_ms") + F.col("k") * cfg.step_ms + start_delay(scene_ms, cfg)).cast("long").alias("overlay_start_ms"),
        F.col("overlay_ms").alias("overlay_ms"),
        F.when(F.col("corner") == "BL", F.lit(cfg.edge_px)).otherwise(wide - F.col("ad_w") - cfg.edge_px)
        .cast("int").alias("x"),
        (high - F.col("ad_h") - cfg.edge_px).cast("int").alias("y"),
        F.col("ad_w").cast("int").alias("w"), F.col("ad_h").cast("int").alias("h"), "corner",
        F.floor(F.col("overlap_sum") / F.col("safe_frames")).cast("long").alias("safe_px"),
        (F.col("quiet") == 1).alias("quiet"))
