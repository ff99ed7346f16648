"""DuckDB statements for the serving and listing queries."""

from __future__ import annotations

from oracle.parts import fold_parts, with_parts

_BASE = "string_split(replace({0}, '\\', '/'), '/')[-1]"
_DONE = f"""SELECT *, row_number() OVER (ORDER BY updated_at DESC, job_id) AS p, count(*) OVER () AS n FROM (
    SELECT job_id, {_BASE.format('video_path')} AS filename, updated_at FROM job_files WHERE status = 'complete')
    WHERE NOT contains(lower(filename), 'samplevideo')"""

_SERVED = fold_parts("sv", "SELECT job_id, decision_id AS id, overlay_start_ms AS s, overlay_ms AS dur, score, 0 AS gap FROM slots", "earlier")

_SLOTS = "SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY job_id, overlay_start_ms ORDER BY score DESC, decision_id) = 1"

_LAYOUT = """SELECT decision_id, display, round(least(rx, dw - box_w), 3) AS box_x, round(least(ry, dh - box_h), 3) AS box_y,
    round(box_w, 3) AS box_w, round(box_h, 3) AS box_h,
    round(CASE WHEN portrait THEN CASE WHEN rx < dw / 2 THEN 30 ELSE dw - fit_w - 30 END ELSE least(rx, dw - fit_w) END, 3) AS fit_x,
    round(dh - fit_h - 100, 3) AS fit_y, round(fit_w, 3) AS fit_w, round(fit_h, 3) AS fit_h FROM (
  SELECT *, CASE WHEN portrait THEN h0 * aspect WHEN w0 / aspect > max_h THEN max_h * aspect ELSE w0 END AS fit_w,
    CASE WHEN portrait THEN h0 WHEN w0 / aspect > max_h THEN max_h ELSE w0 / aspect END AS fit_h FROM (
  SELECT *, least(rw, max_w) AS box_w, least(rh, max_h) AS box_h, nh > nw AS portrait, least(nh * sy, max_h) AS h0, least(nw * sx, max_w) AS w0,
    CASE WHEN nw > 0 AND nh > 0 THEN nw / nh ELSE rw / rh END AS aspect FROM (
  SELECT *, coalesce(anw, rw) AS nw, coalesce(anh, rh) AS nh, dw * 0.28::DOUBLE AS max_w, dh * 0.28::DOUBLE AS max_h FROM (
  SELECT *, coalesce(x * sx, 0) AS rx, coalesce(y * sy, 0) AS ry, CASE WHEN w > 0 THEN w * sx ELSE dw * 0.25::DOUBLE END AS rw,
    CASE WHEN h > 0 THEN h * sy ELSE dh * 0.22::DOUBLE END AS rh FROM (
  SELECT decision_id, x, y, w, h, display, dw, dh, CASE WHEN decision_id % 29 = 0 THEN 1 ELSE dw / 1280 END AS sx,
    CASE WHEN decision_id % 31 = 0 THEN 1 ELSE dh / 720 END AS sy,
    CASE WHEN decision_id % 3 = 0 THEN NULL ELSE 100 + decision_id % 400 END::DOUBLE AS anw,
    CASE WHEN decision_id % 3 = 0 THEN NULL ELSE 100 + (decision_id * 7) % 600 END::DOUBLE AS anh
  FROM decisions CROSS JOIN (VALUES ('tv', 1920.0::DOUBLE, 1080.0::DOUBLE), ('tablet', 1024.0::DOUBLE, 768.0::DOUBLE), ('phone', 640.0::DOUBLE, 360.0::DOUBLE), ('portrait', 360.0::DOUBLE, 640.0::DOUBLE)) v(display, dw, dh))))))"""

ORACLE: dict[str, str] = {
    "overlay_rows": with_parts("""SELECT job_id, decision_id, ad_id, overlay_start_ms, overlay_ms, score, ad_type,
        concat('http://api/media/ads/', CASE ad_type WHEN 'video_clip' THEN 'videos' ELSE 'images' END, '/', """
                               + _BASE.format("resource_path") + """) AS ad_resource_url
        FROM decided JOIN ads USING (ad_id) ORDER BY job_id, overlay_start_ms, score DESC"""),
    "active_overlays": with_parts("""SELECT event_id, p.job_id, pos_ms, decision_id, ad_id, score FROM playback p JOIN decided o
        ON o.job_id = p.job_id AND pos_ms >= overlay_start_ms AND pos_ms < overlay_start_ms + overlay_ms WHERE pos_ms < 715000
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, overlay_start_ms DESC, decision_id DESC) = 1"""),
    "overlay_layout": with_parts(_LAYOUT),
    "overlay_timeline": with_parts("""SELECT job_id, decision_id, ad_id, round(s / total * 100, 6) AS left_pct,
        round(greatest(0.5, overlay_ms / 1000.0::DOUBLE / total * 100), 6) AS width_pct,
        CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', f // 3600, f % 3600 // 60, f % 60) ELSE printf('%d:%02d', f // 60, f % 60) END AS time_label,
        CASE WHEN score >= 60 THEN 'good' WHEN score >= 30 THEN 'fair' ELSE 'low' END AS band FROM (
        SELECT d.*, overlay_start_ms / 1000.0::DOUBLE AS s, overlay_start_ms // 1000 AS f, coalesce(duration_ms / 1000.0::DOUBLE, 1.0) AS total
        FROM decided d LEFT JOIN jobs USING (job_id))"""),
    "served_overlays": with_parts(
        "SELECT job_id, decision_id, ad_id, overlay_start_ms, overlay_ms, score FROM slots JOIN sv_kept k USING (job_id) WHERE k.id = decision_id",
        slots=_SLOTS, **_SERVED),
    "overlay_payload": with_parts(f"""SELECT o.job_id, concat('http://api/media/source/', url_encode({_BASE.format('f.video_path')})) AS video_url,
            j.duration_ms / 1000 AS duration_sec, decision_id, o.ad_id, a.ad_type,
            concat('http://api/media/ads/', CASE a.ad_type WHEN 'video_clip' THEN 'videos' ELSE 'images' END, '/', {_BASE.format('a.resource_path')}) AS ad_resource_url,
            overlay_start_ms / 1000 AS overlay_start_sec, overlay_ms / 1000 AS overlay_sec, d.x, d.y, d.w, d.h, o.score
        FROM sv_kept k JOIN decided o ON o.job_id = k.job_id AND o.decision_id = k.id JOIN decisions d USING (decision_id) JOIN ads a ON a.ad_id = o.ad_id
        JOIN job_files f ON f.job_id = o.job_id JOIN jobs j ON j.job_id = o.job_id""", slots=_SLOTS, **_SERVED),
    "decision_rows": with_parts("SELECT job_id, decision_id, ad_id, overlay_start_ms, overlay_ms, score FROM decided WHERE job_id % 3 <> 0 OR score >= 95"),
    "job_status": with_parts("""SELECT w.job_id, status, video_path, updated_at, f.job_id IS NOT NULL AS found
        FROM (SELECT DISTINCT user_id * 3 AS job_id FROM events) w LEFT JOIN job_files f USING (job_id)"""),
    "completed_jobs": with_parts(f"SELECT job_id, filename, updated_at FROM ({_DONE})"),
    "placement_kpis": with_parts("""SELECT 'job' AS level, CAST(job_id AS VARCHAR) AS key, count(*) AS n_overlays, round(sum(score) / count(score), 6) AS mean_score,
        round(sum(similarity_e3) / count(similarity_e3) / 1000, 6) AS mean_similarity FROM decisions GROUP BY job_id
        UNION ALL SELECT 'ad', ad_id, count(*), round(sum(score) / count(score), 6), round(sum(similarity_e3) / count(similarity_e3) / 1000, 6)
        FROM decisions GROUP BY ad_id"""),
    "recommendation_strip": with_parts("""SELECT 'strip' AS collection, slot::INT AS slot, job_id, filename FROM (
            SELECT row_number() OVER (ORDER BY part, q) AS slot, job_id, filename FROM (
            SELECT 0 AS part, n - p AS q, job_id, filename FROM done_jobs UNION ALL SELECT 1, p, job_id, filename FROM done_jobs)) WHERE slot <= 10
        UNION ALL SELECT 'A', p::INT, job_id, filename FROM done_jobs WHERE p <= 5
        UNION ALL SELECT 'B', (n - p + 1)::INT, job_id, filename FROM done_jobs WHERE n - p < 5
        UNION ALL SELECT 'C', (p - 2)::INT, job_id, filename FROM done_jobs WHERE p BETWEEN 3 AND 7""", done_jobs=_DONE),
    "job_diagnostics": with_parts("""SELECT j.job_id, j.duration_ms::BIGINT AS duration_ms, coalesce(n, 0) AS n_segments,
        j.job_id = (SELECT user_id FROM events GROUP BY user_id ORDER BY min(ts) DESC, user_id DESC LIMIT 1) AS is_latest
        FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM transcript GROUP BY job_id) USING (job_id)"""),
    "watch_progress": with_parts("""SELECT viewer_id, job_id, pos_ms, round(pos_ms / 720000.0::DOUBLE * 100, 6) AS percent, ts AS updated_at,
        pos_ms > 0 AND pos_ms / 720000.0::DOUBLE * 100 < 98 AS resumable FROM playback WHERE job_id IN (SELECT s_suppkey FROM supplier)
        QUALIFY row_number() OVER (PARTITION BY viewer_id, job_id ORDER BY ts DESC, event_id DESC) = 1"""),
}
