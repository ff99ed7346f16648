"""Fixed values and tunable defaults shared by the operators.

Times are integer milliseconds; densities are integers scaled by 10,000.
"""

from __future__ import annotations

from dataclasses import dataclass

# Brand-safety compound keywords, in priority order.
UNSAFE_KEYWORDS = (
    "아동학대", "아동착취", "테러리즘", "테러공격",
    "총기사사", "폭력행위", "살인사건", "자살시도", "자해행위",
    "혐오발언", "인종차별", "성차별",
    "마약거래", "약물남용",
    "성적노출", "선정적장면",
    "사망사고", "중상해", "유해장면",
    "도박중독", "불법도박",
    "장례식장", "장례예배",
)

# Restricted ad category and the context words that admit it.
RESTRICTED_CATEGORY = "주류"
RESTRICTED_CONTEXT_WORDS = ("술", "맥주", "소주", "와인", "음주", "주류", "한잔", "술자리")

# Section labels of a scene description.
SECTION_LABELS = {"situation": "상황:", "emotion": "감정:", "desire": "욕구:"}

# COCO class ids kept by the detector.
DETECTED_CLASS_IDS = (16, 26, 39, 41, 45, 53, 56, 57, 59, 60, 62, 63, 65, 67, 72)
PERSON_CLASS_ID = 0

# Playable video file extensions.
VIDEO_EXTENSIONS = ("mp4", "mkv", "avi", "mov", "ts", "m4v")

# Column order of the exported training table.
TRAINING_COLUMNS = (
    "similarity_score", "final_score", "scene_duration_sec",
    "ad_duration_sec", "avg_density", "ad_type", "label",
)

# The defaults below (thresholds, weights, limits and lengths), but for the sizes of chunks and buckets.


@dataclass(frozen=True)
class SegmentationSettings:
    gap_ms: int = 4000
    min_similarity: float = 0.3
    chunk_ms: int = 600_000


@dataclass(frozen=True)
class MatchSettings:
    base: float = 0.30
    objects: float = 0.38
    long_scene: float = 0.35
    short_scene: float = 0.45
    short_scene_ms: int = 5_000
    long_scene_ms: int = 60_000
    context_weight: float = 0.4
    desire_weight: float = 0.6
    category_similarity: float = 0.35
    top_similar: int = 30
    top_reranked: int = 3

    @property
    def lowest(self) -> float:
        return min(self.base, self.objects, self.long_scene, self.short_scene)


@dataclass(frozen=True)
class PlacementSettings:
    banner_ms: int = 10_000
    step_ms: int = 1_000
    overrun_ms: int = 500
    golden_density_e4: int = 3_000
    danger_density_e4: int = 6_000
    golden_points: int = 25
    silence_points: int = 8
    category_points: int = 10
    semantic_points: int = 80
    quiet_gap_ms: int = 2_000
    edge_px: int = 20
    min_visible_share: float = 0.5
    banner_size: tuple[int, int] = (300, 250)
    clip_size: tuple[int, int] = (320, 180)
    keep_size_pct: int = 5
    snap_size_pct: int = 15
    default_frame: tuple[int, int] = (1280, 720)
    # (minimum scene length, delay) pairs, longest first
    start_delays: tuple[tuple[int, int], ...] = ((30_000, 2_500), (10_000, 1_500), (0, 500))
    bucket_ms: int = 30_000
    chunk_windows: int = 4096


@dataclass(frozen=True)
class ScheduleSettings:
    min_score: int = 20
    # (longest duration, protected time) pairs; the last applies to anything longer
    cold_tiers: tuple[tuple[int, int], ...] = ((1_200_000, 30_000), (2_400_000, 60_000))
    cold_rest_ms: int = 90_000
    cold_unknown_ms: int = 30_000
    interval_unit_ms: int = 60_000
    interval_step_ms: int = 1_800_000
    interval_max_ms: int = 300_000
    interval_unknown_ms: int = 180_000
    hour_ms: int = 3_600_000
    max_per_hour: int = 6


@dataclass(frozen=True)
class DisplaySettings:
    max_share: float = 0.28
    default_width_share: float = 0.25
    default_height_share: float = 0.22
    side_margin: int = 30
    bottom_margin: int = 100
    good_score: int = 60
    fair_score: int = 30
    min_width_pct: float = 0.5


SEGMENTATION = SegmentationSettings()
MATCHING = MatchSettings()
PLACEMENT = PlacementSettings()
SCHEDULE = ScheduleSettings()
DISPLAY = DisplaySettings()
