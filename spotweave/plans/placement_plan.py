"""From raw analysis tables to the schedule, for every job at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotweave.operators import candidates as cand
from spotweave.operators import placement as place
from spotweave.operators.scheduling import schedule
from spotweave.operators.segments import scene_segments, stored_scenes
from spotweave.operators.similarity import category_bonus, class_matches, matched_pairs, with_ids, with_kinds
from spotweave.session import stage
from spotweave.settings import (MATCHING, PLACEMENT, RESTRICTED_CATEGORY, RESTRICTED_CONTEXT_WORDS, SCHEDULE,
                                SEGMENTATION, UNSAFE_KEYWORDS, MatchSettings, PlacementSettings,
                                ScheduleSettings, SegmentationSettings)


@dataclass(frozen=True)
class Inputs:
    """Tables of the analysis store.

    ``desires`` (ctx_vec, desire_vec), ``narrative_ids`` (vec_id, narrative_id) and ``pair_scores`` (ctx_vec, ad_id,
    pair_score) have at most one row per key and may lack keys.
    """
    info: DataFrame
    segments: DataFrame
    frames: DataFrame
    silence: DataFrame
    ads: DataFrame
    vectors: DataFrame
    category_vectors: DataFrame
    narratives: DataFrame
    desires: DataFrame
    narrative_ids: DataFrame
    pair_scores: DataFrame


@dataclass(frozen=True)
class PlanSettings:
    segmentation: SegmentationSettings = SEGMENTATION
    matching: MatchSettings = MATCHING
    placement: PlacementSettings = PLACEMENT
    scheduling: ScheduleSettings = SCHEDULE
    unsafe_words: tuple[str, ...] = UNSAFE_KEYWORDS
    gate_tag: str = RESTRICTED_CATEGORY
    gate_words: tuple[str, ...] = RESTRICTED_CONTEXT_WORDS


class PlacementPlan:
    """Lazy tables of one placement run; shared intermediate tables are staged once."""

    def __init__(self, inputs: Inputs, settings: PlanSettings = PlanSettings()):
        self.inputs = inputs
        self.settings = settings
        self._staged: dict[str, DataFrame] = {}

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = stage(build(), name)
        return self._staged[name]

    def frames(self) -> DataFrame:
        return self.inputs.frames

    def scenes(self) -> DataFrame:
        """Stored scenes with their context and desire vector ids (-1: none)."""
        i = self.inputs
        return self._once("scenes", lambda: stored_scenes(scene_segments(
            i.segments, i.vectors, i.info, self.settings.segmentation)).join(i.desires, "ctx_vec", "left").withColumn(
            "desire_vec", F.coalesce("desire_vec", F.lit(-1)).cast("long")))

    def text_flags(self) -> DataFrame:
        """Unsafe word and gate per narrative text, evaluated once per distinct text."""
        flagged = cand.brand_safety(self.inputs.narratives, "text", self.settings.unsafe_words)
        return cand.category_gate(flagged, "text", self.settings.gate_words).drop("text")

    def scene_context(self) -> DataFrame:
        """Scenes with objects, threshold, unsafe_word and gate_open."""
        i, m = self.inputs, self.settings.matching
        scenes = cand.scene_objects(self.scenes(), self.frames())
        length = F.col("end_ms") - F.col("start_ms")
        scenes = scenes.withColumn("threshold", cand.sim_threshold(length, F.col("objects"), m))
        # Flags per vector, by way of its narrative.
        flags = i.narrative_ids.join(self.text_flags(), "narrative_id").drop("narrative_id")
        own = scenes.join(flags.withColumnRenamed("vec_id", "ctx_vec"), "ctx_vec", "left")
        wish = flags.select(F.col("vec_id").alias("desire_vec"), F.col("gate_open").alias("wish_open"))
        own = own.join(wish, "desire_vec", "left").withColumn("gate_open", F.coalesce("gate_open", F.lit(False))
                                                               | F.coalesce("wish_open", F.lit(False))).drop("wish_open")
        return cand.with_fit(own.withColumn("scene_ms", length), i.ads, "scene_ms").drop("scene_ms").select(
            *cand.SCENE, "end_ms", "unsafe_word", *cand.CLASS)

    def placed_scenes(self) -> DataFrame:
        """Scenes that can take ads, with their class."""
        return self._once("placed", lambda: self.scene_context().filter(F.col("ctx_vec").isNotNull())
                          .withColumn("class_id", F.xxhash64(*cand.CLASS)))

    def context_ids(self) -> DataFrame:
        """Distinct (context, desire) vector ids of all scenes."""
        return self._once("contexts", lambda: self.scenes().filter(F.col("ctx_vec").isNotNull())
                          .select("ctx_vec", "desire_vec").distinct())

    def n_contexts(self) -> int:
        return self.context_ids().count()

    def contexts(self) -> DataFrame:
        """Distinct contexts with their vectors, written as every product reads them twice."""
        return self._once("context-vectors", self._contexts)

    def _contexts(self) -> DataFrame:
        i, distinct = self.inputs, self.context_ids()
        ctx = i.vectors.select(F.col("vec_id").alias("ctx_vec"), F.col("embedding").alias("ctx_emb"))
        desire = i.vectors.select(F.col("vec_id").alias("desire_vec"), F.col("embedding").alias("desire_emb"))
        return distinct.join(ctx, "ctx_vec").join(desire, "desire_vec", "left")

    def ads(self) -> DataFrame:
        """Ads by what admits them: ad_id, tgt_vec, needs_ms, gated."""
        needs = F.when((F.col("ad_type") == "video_clip") & F.col("duration_ms").isNotNull(),
                       F.col("duration_ms")).otherwise(F.lit(0)).cast("long")
        return self.inputs.ads.select("ad_id", "tgt_vec", needs.alias("needs_ms"),
                                      cand.restricted(F.col("ad_category_path"), self.settings.gate_tag).alias("gated"))

    def target_vectors(self) -> DataFrame:
        return self.inputs.vectors.select(F.col("vec_id").alias("tgt_vec"), F.col("embedding").alias("tgt_emb"))

    def weighted_targets(self) -> DataFrame:
        """Distinct vectors of the ads with the number of ads (``weight``), for sums that ask no more of an ad than its vector."""
        used = self.inputs.ads.groupBy("tgt_vec").agg(F.count("*").alias("weight"))
        return self._once("target-vectors", lambda: used.join(self.target_vectors(), "tgt_vec").select(
            F.col("tgt_vec").cast("string").alias("ad_id"), "tgt_emb", "weight"))

    def matched_pairs(self) -> DataFrame:
        """Pairs of distinct contexts and ads above the lowest threshold."""
        m = self.settings.matching
        return matched_pairs(self.contexts(), with_ids(self.inputs.ads, self.target_vectors()), m.lowest, m, self.n_contexts())

    def class_matches(self) -> DataFrame:
        """First ads and totals of every scene class, per ad block."""
        return self._once("matches", lambda: self._matches(totals=True))

    def _matches(self, totals: bool) -> DataFrame:
        m = self.settings.matching
        return class_matches(self.contexts(), cand.scene_classes(self.placed_scenes()),
                             with_kinds(self.ads(), self.target_vectors(), m.top_similar), m.top_similar, m, totals)

    def admitted(self) -> DataFrame:
        """Scenes with the number, sum and best of their admitted similarities."""
        return self.placed_scenes().join(cand.class_totals(self.class_matches()), "class_id")

    def class_lists(self) -> DataFrame:
        """First ads of every scene class, in one list; ad blocks that cannot hold one of them are not visited."""
        k = self.settings.matching.top_similar
        return self._once("tops", lambda: cand.class_lists(self._matches(totals=False), k))

    def top_similar(self) -> DataFrame:
        return cand.listed(self.placed_scenes().join(self.class_lists(), "class_id"))

    def reranked(self) -> DataFrame:
        lists = self.class_lists().join(cand.scene_classes(self.placed_scenes()).select("class_id", "ctx_vec"), "class_id")
        kept = self._once("reranked", lambda: cand.rerank_lists(lists, self.settings.matching.top_reranked, self.inputs.pair_scores))
        rows = self.placed_scenes().join(kept.drop("ctx_vec"), "class_id").drop("class_id", "desire_vec", "gate_open", "fit_ms")
        return cand.listed(rows, "rerank")

    def bonuses(self) -> DataFrame:
        i = self.inputs
        used = self.context_ids().select(F.col("ctx_vec").alias("vec_id")).distinct()
        cats = i.category_vectors.withColumnRenamed("cat_vec", "vec_id").join(i.vectors, "vec_id")
        return category_bonus(used.join(i.vectors, "vec_id"), cats.select("ad_category", "embedding"),
                              self.settings.placement.category_points, self.settings.matching, self.n_contexts())

    def planned(self) -> DataFrame:
        """Re-ranked candidates with window plan, reference ad size and category bonus."""
        def build() -> DataFrame:
            p = self.settings.placement
            ads = self.inputs.ads.select("ad_id", "ad_type", "ad_category", F.col("duration_ms").alias("ad_ms"))
            rows = self.reranked().join(ads, "ad_id")
            rows = rows.join(self.bonuses(), ["ctx_vec", "ad_category"], "left")
            w, h = place.reference_size(F.col("ad_type"), p)
            return place.with_window_plan(
                rows.withColumn("category_bonus", F.coalesce("bonus", F.lit(0)))
                .withColumn("ad_w", w).withColumn("ad_h", h).drop("bonus"), p)
        return self._once("planned", build)

    def requests(self) -> DataFrame:
        return self._once("requests", lambda: place.window_requests(self.planned()))

    def features(self) -> DataFrame:
        i = self.inputs
        return place.window_features(self.requests(), self.frames(), i.segments, i.silence, i.info,
                                     self.settings.placement)

    def scored(self) -> DataFrame:
        p = self.settings.placement
        best = self._once("best-windows", lambda: place.best_windows(self.features(), p))
        return place.score_candidates(self.planned(), best, self.inputs.info, self.settings.matching, p)

    def schedule(self) -> DataFrame:
        return schedule(self.scored(), self.inputs.info, self.settings.scheduling)
