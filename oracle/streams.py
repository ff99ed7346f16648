"""DuckDB statements for the streaming queries (what a drained stream must have produced)."""

from __future__ import annotations

from oracle.parts import with_parts

ORACLE: dict[str, str] = {
    "stream_ingest_dedup": with_parts("SELECT DISTINCT job_id, start_ms, end_ms, text FROM transcript"),
    "stream_feedback_latest": with_parts("""SELECT decision_id, label::INT AS label, source, event_id FROM (
            SELECT event_id % 3000 AS decision_id, (event_id * 7) % 4 - 1 AS label, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'auto' END AS source, ts, event_id FROM events)
        WHERE label <= 1 AND decision_id IN (SELECT decision_id FROM decisions)
        QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY ts DESC, event_id DESC) = 1"""),
    "stream_job_status": """SELECT user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'analysing' END AS status,
            ts AS updated_at, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS phase
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "stream_impressions": with_parts("""SELECT ad_id, count(*) AS n_impressions FROM (SELECT event_id, ad_id FROM playback p JOIN decided o
        ON o.job_id = p.job_id AND pos_ms >= overlay_start_ms AND pos_ms < overlay_start_ms + overlay_ms
        QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, overlay_start_ms DESC, decision_id DESC) = 1) GROUP BY ad_id"""),
    "stream_gap_scenes": with_parts("""SELECT job_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_segments FROM (
            SELECT *, sum(CASE WHEN start_ms - before <= 4000 THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY start_ms, seg_id) AS g FROM (
            SELECT *, lag(end_ms) OVER (PARTITION BY job_id ORDER BY start_ms, seg_id) AS before FROM transcript))
        WHERE job_id IN (SELECT job_id FROM transcript WHERE text = 'purchase') GROUP BY job_id, g"""),
}
