"""DuckDB statements for the scene, matching, placement and scheduling queries."""

from __future__ import annotations

from oracle.parts import fold_parts, with_parts
from oracle.sequences import AREA, DENSITY

_REQ = "job_id, start_ms, window_ms, ad_w"
_DEC = "job_id, decision_id, ad_id, overlay_start_ms, overlay_ms, score"
_OVL = "job_id, start_ms, ad_id, score, overlay_start_ms, overlay_ms"
_ZONE = "CASE WHEN duration_ms IS NULL THEN 30000 WHEN duration_ms <= 1200000 THEN 30000 WHEN duration_ms <= 2400000 THEN 60000 ELSE 90000 END"
_GAP = "CASE WHEN duration_ms IS NULL THEN 180000 ELSE least(300000, greatest(60000, 60000 * (duration_ms // 1800000 + 1))) END"


def _cold(source: str) -> str:
    return (f"SELECT d.* FROM {source} d LEFT JOIN jobs j USING (job_id) WHERE overlay_start_ms >= {_ZONE} "
            f"AND (duration_ms IS NULL OR overlay_start_ms <= duration_ms - {_ZONE})")


_DECIDED = "SELECT job_id, decision_id AS id, overlay_start_ms AS s, overlay_ms AS dur, score, {gap} AS gap FROM decided {join}"
_OVERLAPS = fold_parts("ov", _DECIDED.format(gap="0", join=""), "overlap")
_SPACED = fold_parts("sp", _DECIDED.format(gap=_GAP, join="LEFT JOIN jobs USING (job_id)"), "spacing")

_PLAN_OVERLAPS = fold_parts(
    "po", "SELECT job_id, start_ms AS id, overlay_start_ms AS s, overlay_ms AS dur, score, 0 AS gap FROM best20", "overlap")
_PLAN_SPACED = fold_parts(
    "ps", f"SELECT job_id, start_ms AS id, overlay_start_ms AS s, overlay_ms AS dur, score, {_GAP} AS gap "
          "FROM warm LEFT JOIN jobs USING (job_id)", "spacing")

_DETECTED = {**DENSITY, **AREA, "frames": """SELECT job_id, frame_index, frame_index * 1000 AS ts_ms, density_e4, objects, safe_x, safe_y, safe_w, safe_h
    FROM densities JOIN areas USING (job_id, frame_index)"""}

_DENSITY_ROWS = f"""SELECT {_REQ}, count(*) AS n_windows,
        count(*) FILTER (density_sum >= 6000 * frames) AS n_danger, count(*) FILTER (density_sum <= 3000 * frames) AS n_golden,
        sum(density_sum)::BIGINT AS density_sum, sum(frames)::BIGINT AS n_frames FROM win_frames GROUP BY {_REQ}"""
_CORNER_ROWS = f"""SELECT {_REQ}, count(*) FILTER (corner = 'BL') AS n_bl, count(*) FILTER (corner = 'BR') AS n_br,
        count(*) FILTER (corner IS NULL) AS n_none, sum(greatest(bl_sum, br_sum))::BIGINT AS overlap_sum FROM features GROUP BY {_REQ}"""
_SCHEDULE_ROWS = f"""SELECT {_OVL}, round(sim, 6) AS sim, round(avg_density, 6) AS avg_density, x, y, w, h, corner, quiet
        FROM warm JOIN ps_kept k USING (job_id) WHERE k.id = start_ms
        QUALIFY row_number() OVER (PARTITION BY job_id, ad_id ORDER BY overlay_start_ms) = 1"""
_SCHEDULE_PARTS = {**_PLAN_OVERLAPS, "clear": "SELECT b.* FROM best20 b JOIN po_kept k ON k.job_id = b.job_id AND k.id = b.start_ms",
                   "warm": _cold("clear"), **_PLAN_SPACED}

ORACLE: dict[str, str] = {
    "scene_segments": with_parts(
        "SELECT job_id, scene_no, start_ms, end_ms, n_segments, ctx_vec, transcript FROM scenes_raw"),
    "candidates": with_parts(
        """SELECT job_id, count(DISTINCT start_ms) AS n_scenes, count(*) AS n_candidates,
        count(*) FILTER (ad_type = 'video_clip') AS n_clip_candidates,
        count(*) FILTER (NOT (ad_type = 'video_clip' AND coalesce(end_ms - start_ms < a.duration_ms, false))) AS n_fitting
        FROM scenes CROSS JOIN ads a GROUP BY job_id"""),
    "scene_objects": with_parts("SELECT job_id, start_ms, end_ms, objects FROM scene_objects"),
    "brand_safety": """SELECT doc_id, CASE WHEN contains(text, 'reing') THEN 'reing'
        WHEN contains(text, 'attion') THEN 'attion' END AS unsafe_word FROM documents""",
    "category_gate": with_parts("""SELECT doc_id, contains(text, 'anon') AS gate_open,
        CASE WHEN contains(text, 'anon') THEN 0 ELSE (SELECT count(*) FROM ads WHERE list_contains(ad_category_path, 'ring')) END AS blocked_ads
        FROM documents"""),
    "scene_thresholds": with_parts("SELECT job_id, start_ms, threshold FROM scene_ctx"),
    "ad_size_tiers": with_parts(
        """SELECT ad_id, CASE tier WHEN 0 THEN rw WHEN 1 THEN width WHEN 2 THEN rw END::INT AS ad_w,
        CASE tier WHEN 0 THEN rh WHEN 1 THEN height WHEN 2 THEN rh END::INT AS ad_h, tier = 3 AS dropped FROM (
        SELECT *, CASE WHEN width IS NULL OR width <= 0 THEN 0 WHEN abs(width - rw) / rw <= 0.05 AND abs(height - rh) / rh <= 0.05 THEN 1
            WHEN abs(width - rw) / rw <= 0.15 AND abs(height - rh) / rh <= 0.15 THEN 2 ELSE 3 END AS tier FROM (
        SELECT *, CASE WHEN ad_type = 'video_clip' THEN 320 ELSE 300 END AS rw,
            CASE WHEN ad_type = 'video_clip' THEN 180 ELSE 250 END AS rh FROM ads))"""),
    "pair_similarity": with_parts(
        "SELECT vec_id AS ctx_vec, ad_id, round(sim, 6) AS sim FROM cosines WHERE sim >= 0.10"),
    "blended_similarity": with_parts(
        "SELECT ctx_vec, desire_vec, ad_id, round(sim, 6) AS sim FROM blended WHERE sim >= 0.10"),
    "category_bonus": with_parts("SELECT ctx_vec, ad_category, bonus FROM bonuses"),
    "prefilter": with_parts("""SELECT job_id, start_ms, count(*) AS n_kept, round(max(sim), 6) AS best_sim,
        round(sum(sim) / count(*), 6) AS mean_sim FROM prefiltered GROUP BY ALL"""),
    "topk_per_scene": with_parts("SELECT job_id, start_ms, rank::INT AS rank, ad_id, round(sim, 6) AS sim FROM topk"),
    "rerank_top3": with_parts("""SELECT job_id, start_ms, rerank::INT AS rerank, ad_id, round(sim, 6) AS sim,
        round(pair_score, 6) AS pair_score FROM reranked"""),
    "placement_windows": with_parts("""SELECT job_id, start_ms, ad_id, count(*) AS n_windows,
        min(start_ms + 1000 * k) AS first_start_ms, max(start_ms + 1000 * k) AS last_start_ms
        FROM planned, generate_series(0, (end_ms + 500 - start_ms - window_ms) // 1000) g(k) GROUP BY job_id, start_ms, ad_id"""),
    "window_density": with_parts(_DENSITY_ROWS),
    "best_corner": with_parts(_CORNER_ROWS),
    "detected_density": with_parts(_DENSITY_ROWS, **_DETECTED),
    "detected_corner": with_parts(_CORNER_ROWS, **_DETECTED),
    "window_silence": with_parts(f"""SELECT {_REQ}, count(*) AS n_windows, count(*) FILTER (quiet) AS n_quiet
        FROM features GROUP BY {_REQ}"""),
    "scored_candidates": with_parts("""SELECT job_id, start_ms, ad_id, score, round(sim, 6) AS sim,
        round(avg_density, 6) AS avg_density, overlay_start_ms, overlay_ms, x, y, w, h, corner, safe_px, quiet FROM scored"""),
    "best_per_scene": with_parts(f"SELECT {_OVL} FROM best20"),
    "schedule_overlaps": with_parts(
        f"SELECT {_DEC} FROM decided JOIN ov_kept k USING (job_id) WHERE k.id = decision_id", **_OVERLAPS),
    "cold_zones": with_parts(f"SELECT {_DEC} FROM ({_cold('decided')})"),
    "schedule_spacing": with_parts(
        f"SELECT {_DEC} FROM decided JOIN sp_kept k USING (job_id) WHERE k.id = decision_id", **_SPACED),
    "schedule_unique": with_parts(f"""SELECT {_DEC} FROM decided QUALIFY
        row_number() OVER (PARTITION BY job_id, ad_id ORDER BY overlay_start_ms, decision_id) = 1"""),
    "ad_schedule": with_parts(_SCHEDULE_ROWS, **_SCHEDULE_PARTS),
    "detected_schedule": with_parts(_SCHEDULE_ROWS, **_DETECTED, **_SCHEDULE_PARTS),
}
