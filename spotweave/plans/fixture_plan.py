"""The placement plan over the warehouse tables, with thresholds suited to their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spotweave.operators.frames import frame_measures
from spotweave.plans.placement_plan import Inputs, PlacementPlan, PlanSettings
from spotweave.settings import MatchSettings, SegmentationSettings
from spotweave.sources import fixtures as fx

SETTINGS = PlanSettings(
    segmentation=SegmentationSettings(min_similarity=0.02),
    matching=MatchSettings(base=0.10, long_scene=0.12, objects=0.13, short_scene=0.15,
                           category_similarity=0.12),
    unsafe_words=fx.FIXTURE_SAFETY_WORDS, gate_tag=fx.FIXTURE_GATE_TAG, gate_words=fx.FIXTURE_GATE_WORDS)


class FixturePlan(PlacementPlan):
    """Frames are themselves derived here, so they are staged before their two uses."""

    def frames(self) -> DataFrame:
        return self._once("frames", lambda: self.inputs.frames)


def detected_frames(spark: SparkSession, d: str) -> DataFrame:
    """Density, objects and safe area of every frame as its detections give them."""
    boxes = fx.detections(spark, d)
    return frame_measures(boxes, boxes, fx.jobs(spark, d), 1280, 720)


def fixture_plan(spark: SparkSession, d: str, settings: PlanSettings = SETTINGS, detected: bool = False) -> FixturePlan:
    """The plan over stored frame features or, with ``detected``, over those worked out from detections."""
    return FixturePlan(Inputs(
        info=fx.jobs(spark, d), segments=fx.transcript(spark, d), frames=detected_frames(spark, d) if detected else fx.frames(spark, d),
        silence=fx.silence(spark, d), ads=fx.ads(spark, d), vectors=fx.vectors(spark, d),
        category_vectors=fx.category_vectors(spark, d), narratives=fx.narratives(spark, d),
        desires=fx.desires(spark, d), narrative_ids=fx.narrative_ids(spark, d), pair_scores=fx.pair_scores(spark, d)), settings)
