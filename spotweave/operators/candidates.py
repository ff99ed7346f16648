"""From scenes and ads to the few candidates per scene worth placing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.operators.intervals import points_in
from spotweave.operators.ordered import running_max_before, running_total, span_chunk
from spotweave.settings import (MATCHING, RESTRICTED_CONTEXT_WORDS, UNSAFE_KEYWORDS, MatchSettings)

SCENE = ["job_id", "start_ms"]


FEW_WORDS = 64  # up to here each word is a search of its own; longer lists cost one pass over the text


@lru_cache(maxsize=4)
def _automaton(words: tuple[str, ...]):
    """Aho-Corasick automaton of the words that are not empty, each with its first place in the list."""
    import ahocorasick
    found = ahocorasick.Automaton()
    for place, word in enumerate(words):
        if word and word not in found:
            found.add_word(word, place)
    found.make_automaton()
    return found


def _first_listed(words: tuple[str, ...]) -> Callable[[Column], Column]:
    """The first listed word a text contains, in one pass over the text."""
    blank = words.index("") if "" in words else len(words)

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        automaton = _automaton(words)

        def of(text: str | None) -> str | None:
            if text is None:
                return None
            place = min((p for _, p in automaton.iter(text)), default=blank) if len(automaton) else blank
            return words[min(place, blank)] if min(place, blank) < len(words) else None
        return pd.Series([of(t) for t in texts], dtype=object)

    return first


def first_keyword(text: Column, words: Sequence[str]) -> Column:
    """First listed word the text contains, NULL when there is none."""
    if len(words) <= FEW_WORDS:
        return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), F.lit(0))
    return _first_listed(tuple(words))(text)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text contains one of the words; NULL for NULL."""
    if len(words) <= FEW_WORDS:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return F.when(text.isNotNull(), _first_listed(tuple(words))(text).isNotNull())


def brand_safety(texts: DataFrame, text: str, words: Sequence[str] = UNSAFE_KEYWORDS) -> DataFrame:
    """Add ``unsafe_word`` (NULL when the text is safe)."""
    return texts.withColumn("unsafe_word", first_keyword(F.col(text), words))


def category_gate(texts: DataFrame, text: str, words: Sequence[str] = RESTRICTED_CONTEXT_WORDS) -> DataFrame:
    """Add ``gate_open``: the text mentions a word that admits the restricted category."""
    return texts.withColumn("gate_open", contains_any(F.col(text), words))


def restricted(path: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(path, tag), F.lit(False))


def scene_objects(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """Scenes with ``objects``: distinct object strings of their frames (both ends inclusive)."""
    seen = frames.filter(F.col("objects") != "").select("job_id", "ts_ms", "objects")
    spans = scenes.select("job_id", "start_ms", "end_ms")
    listed = (points_in(seen, spans, ["job_id"], "ts_ms", "start_ms", "end_ms")
              .groupBy(*SCENE).agg(F.array_join(F.array_sort(F.collect_set("objects")), ", ").alias("objects")))
    return scenes.join(listed, SCENE, "left").withColumn("objects", F.coalesce("objects", F.lit("")))


def sim_threshold(length_ms: Column, objects: Column, cfg: MatchSettings = MATCHING) -> Column:
    named = F.trim(objects)
    return (F.when(length_ms < cfg.short_scene_ms, F.lit(cfg.short_scene))
            .when(length_ms >= cfg.long_scene_ms, F.lit(cfg.long_scene))
            .when(F.coalesce((named != "") & (F.lower(named) != "none"), F.lit(False)), F.lit(cfg.objects))
            .otherwise(F.lit(cfg.base)))


def fits_scene(scene_ms: Column, ad_type: Column, ad_ms: Column) -> Column:
    return ~F.coalesce((ad_type == "video_clip") & (scene_ms < ad_ms), F.lit(False))


def with_fit(scenes: DataFrame, ads: DataFrame, length: str) -> DataFrame:
    """Add ``fit_ms``: the longest clip length that the scene length holds, 0 when there is none.

    Only the distinct lengths of scenes and clips are put in order.
    """
    clips = (ads.filter((F.col("ad_type") == "video_clip") & (F.col("duration_ms") > 0))
             .select(F.col("duration_ms").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("duration_ms").cast("long").alias("_clip")))
    spans = scenes.select(F.col(length).cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_clip"))
    points = clips.distinct().unionByName(spans.distinct()).withColumn("_all", F.lit(0))
    held = running_max_before(points, ["_all"], span_chunk("_at", 60_000), ["_at", "_kind"], "_clip", "fit_ms")
    found = held.filter("_kind = 1").select(F.col("_at").alias(length), F.coalesce("fit_ms", F.lit(0).cast("long")).alias("fit_ms"))
    return scenes.join(found, length)


def candidate_volume(scenes: DataFrame, ads: DataFrame) -> DataFrame:
    """Scene x ad pairs per job, by counting: the pairs themselves are never built.

    A clip fits every scene at least as long as itself, so the clips that fit a scene length are a running
    number over the distinct clip and scene lengths.
    """
    by_type = ads.agg(F.count("*").alias("n_ads"),
                      F.count(F.when(F.col("ad_type") == "video_clip", 1)).alias("n_clips"))
    per_length = scenes.groupBy("job_id", (F.col("end_ms") - F.col("start_ms")).alias("scene_ms")).agg(F.count("*").alias("n_scenes"))
    clips = (ads.filter((F.col("ad_type") == "video_clip") & F.col("duration_ms").isNotNull())
             .groupBy(F.col("duration_ms").cast("long").alias("_at")).agg(F.count("*").alias("_n")).withColumn("_kind", F.lit(0)))
    spans = per_length.select(F.col("scene_ms").alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_kind")).distinct()
    points = clips.unionByName(spans).withColumn("_all", F.lit(0))
    held = running_total(points, ["_all"], span_chunk("_at", 60_000), ["_at", "_kind"], F.col("_n"), "n_short")
    fits = held.filter("_kind = 1").select(F.col("_at").alias("scene_ms"), "n_short")
    n_ads = by_type.select("n_ads").scalar()
    n_clips = by_type.select("n_clips").scalar()
    # A clip of unknown length fits everywhere.
    n_timed = ads.agg(F.count(F.when((F.col("ad_type") == "video_clip") & F.col("duration_ms").isNotNull(), 1)).alias("n")).select("n").scalar()
    return per_length.join(fits, "scene_ms").groupBy("job_id").agg(
        F.sum("n_scenes").alias("n_scenes"),
        F.sum(F.col("n_scenes") * n_ads).alias("n_candidates"),
        F.sum(F.col("n_scenes") * n_clips).alias("n_clip_candidates"),
        F.sum(F.col("n_scenes") * (n_ads - n_timed + F.col("n_short"))).alias("n_fitting"))


CLASS = ["ctx_vec", "desire_vec", "threshold", "gate_open", "fit_ms"]


def scene_classes(scenes: DataFrame) -> DataFrame:
    """Distinct combinations of all that decides which ads a scene admits, numbered by a digest of their columns.

    ``scenes``: ctx_vec, desire_vec, threshold, gate_open, fit_ms. Scenes without a vector belong to none.
    """
    return scenes.filter(F.col("ctx_vec").isNotNull()).select(*CLASS).distinct().withColumn("class_id", F.xxhash64(*CLASS))


def class_totals(found: DataFrame) -> DataFrame:
    """Number, sum and best of the admitted similarities of each class, over all ad blocks."""
    return found.groupBy("class_id").agg(F.sum("n_kept").alias("n_kept"), F.sum("sim_sum").alias("sim_sum"), F.max("best_sim").alias("best_sim"))


def class_lists(found: DataFrame, k: int) -> DataFrame:
    """(class_id, top): the ``k`` most similar ads of each class in order, ARRAY<STRUCT<minus_sim, ad_id>>, merged from at most k of each ad block."""
    rows = found.select("class_id", F.transform(F.arrays_zip("ids", "sims"), lambda m: F.struct((-m["sims"]).alias("minus_sim"), m["ids"].alias("ad_id"))).alias("_some"))
    return rows.groupBy("class_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_some"))), 1, k).alias("top"))


def listed(lists: DataFrame, rank: str = "rank") -> DataFrame:
    """The rows of ``lists`` with one row for each of ``top``: its place ``rank`` and the fields ad_id and sim."""
    rest = [c for c in lists.columns if c != "top"]
    return lists.select(*rest, F.posexplode("top").alias("_at", "_ad")).select(
        *rest, (F.col("_at") + 1).alias(rank), "_ad.ad_id", (-F.col("_ad.minus_sim")).alias("sim"),
        *[F.col("_ad.pair_score")] * ("pair_score" in lists.schema["top"].dataType.elementType.names))


def class_top(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar ads of each class: (class_id, rank, ad_id, sim), merged from at most k of each ad block."""
    return listed(class_lists(found, k))


def rerank_lists(lists: DataFrame, k: int, pair_scores: DataFrame) -> DataFrame:
    """:func:`class_rerank` for lists (class_id, ctx_vec, top): the same columns, ``k`` ads in ``top``, with their ``pair_score``.

    Classes of a context share most of their ads, so each pair is looked up once and what is known of a context goes along with its lists.
    """
    asked = lists.select("ctx_vec", F.explode("top.ad_id").alias("ad_id")).distinct()
    # As long as the pairs that were scored: moved between tasks, not broadcast by way of the driver.
    known = pair_scores.filter(F.col("pair_score").isNotNull()).select("ctx_vec", "ad_id", "pair_score").hint("merge").join(asked, ["ctx_vec", "ad_id"])
    scores = known.groupBy("ctx_vec").agg(F.map_from_entries(F.collect_list(F.struct("ad_id", "pair_score"))).alias("_scores"))

    def rescored(ad: Column) -> Column:
        score = F.try_element_at("_scores", ad["ad_id"])
        score = F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).otherwise(-ad["minus_sim"])
        return F.struct((-score).alias("minus_score"), ad["minus_sim"].alias("minus_sim"), ad["ad_id"].alias("ad_id"), score.alias("pair_score"))

    return lists.join(scores, "ctx_vec", "left").withColumn("top", F.slice(F.array_sort(F.transform("top", rescored)), 1, k)).drop("_scores")


def class_rerank(top: DataFrame, k: int, pair_scores: DataFrame) -> DataFrame:
    """Keep ``k`` ads per class by an external score in [0, 1], falling back to the similarity.

    ``top``: class_id, ctx_vec, ad_id, sim; ``pair_scores``: ctx_vec, ad_id, pair_score, one row per pair, pairs may be
    missing. The score only selects; ``sim`` stays what is scored later.
    """
    # As long as the pairs that were scored: moved between tasks, not broadcast by way of the driver.
    known = pair_scores.select("ctx_vec", "ad_id", "pair_score").hint("merge")
    scored = top.join(known, ["ctx_vec", "ad_id"], "left")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("pair_score")))
    order = Window.partitionBy("class_id").orderBy(F.desc("pair_score"), F.desc("sim"), "ad_id")
    # greatest and least skip NULL, so a missing score is told apart first.
    return (scored.withColumn("pair_score", F.when(F.col("pair_score").isNotNull(), score).otherwise(F.col("sim")))
            .withColumn("rerank", F.row_number().over(order)).filter(F.col("rerank") <= k))
