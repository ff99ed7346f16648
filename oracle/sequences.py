"""DuckDB statements for the interval, sampling, audio and frame-feature queries."""

from __future__ import annotations

from oracle.parts import with_parts
from spotweave.settings import DETECTED_CLASS_IDS

_STRIDE = 6
_COLS, _TOP, _BOTTOM = 214, 15, 111  # grid columns, first and one past the last free row
_CLASSES = ", ".join(map(str, DETECTED_CLASS_IDS))
_CUT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(z[1] * 255.0::DOUBLE - z[2] * 255.0::DOUBLE))) / 64"

_FRAMES = {"every_frame": "SELECT DISTINCT job_id, frame_index FROM detections"}
DENSITY = {**_FRAMES, "densities": f"""SELECT job_id, frame_index, coalesce(least(10000, (area * 20000 + 921600) // 1843200), 0)::BIGINT AS density_e4, coalesce(objects, '') AS objects
    FROM every_frame LEFT JOIN (
        SELECT job_id, frame_index, sum(greatest(0, least(1280, x2) - greatest(0, x1))::BIGINT * greatest(0, least(720, y2) - greatest(0, y1))) AS area,
            string_agg(DISTINCT class_name, ', ' ORDER BY class_name) AS objects FROM detections
        WHERE confidence_pct >= 35 AND class_id IN ({_CLASSES}) GROUP BY ALL) USING (job_id, frame_index)"""}
# The edges of a largest free rectangle touch obstacles or borders: try all such edges in grid cells.
AREA = {**_FRAMES,
    "obstacles": f"""SELECT job_id, frame_index, ceil(x1 / {_STRIDE})::INT AS c1, ceil(x2 / {_STRIDE})::INT AS c2, ceil(y1 / {_STRIDE})::INT AS r1, ceil(y2 / {_STRIDE})::INT AS r2 FROM (
            SELECT job_id, frame_index, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(1280, x2) AS x2, least(720, y2) AS y2 FROM detections WHERE confidence_pct >= 35
            UNION ALL SELECT job_id, frame_index, greatest(0, x1 - pad), greatest(0, y1 - pad), least(1280, x2 + pad), least(720, y1 + (y2 - y1) // 2 + pad)
            FROM (SELECT *, greatest(2, greatest(x2 - x1, y2 - y1) * 3 // 100) AS pad FROM detections WHERE class_id = 0 AND confidence_pct >= 35))
        WHERE c1 < c2 AND r1 < r2""",
    "lefts": f"SELECT job_id, frame_index, 0 AS c1 FROM every_frame UNION SELECT job_id, frame_index, c2 FROM obstacles WHERE c2 < {_COLS}",
    "rights": f"SELECT job_id, frame_index, {_COLS} AS c2 FROM every_frame UNION SELECT job_id, frame_index, c1 FROM obstacles WHERE c1 > 0",
    "tops": f"SELECT job_id, frame_index, {_TOP} AS r1 FROM every_frame UNION SELECT job_id, frame_index, r2 FROM obstacles WHERE r2 > {_TOP} AND r2 < {_BOTTOM}",
    "bottoms": f"SELECT job_id, frame_index, {_BOTTOM} AS r2 FROM every_frame UNION SELECT job_id, frame_index, r1 FROM obstacles WHERE r1 > {_TOP} AND r1 < {_BOTTOM}",
    "spans": """SELECT l.job_id, l.frame_index, l.c1, g.c2, t.r1, b.r2 FROM lefts l JOIN rights g ON g.job_id = l.job_id AND g.frame_index = l.frame_index AND l.c1 < g.c2
        JOIN tops t ON t.job_id = l.job_id AND t.frame_index = l.frame_index JOIN bottoms b ON b.job_id = l.job_id AND b.frame_index = l.frame_index AND t.r1 < b.r2
        ANTI JOIN obstacles o ON o.job_id = l.job_id AND o.frame_index = l.frame_index AND o.c1 < g.c2 AND o.c2 > l.c1 AND o.r1 < b.r2 AND o.r2 > t.r1""",
    "areas": f"""SELECT job_id, frame_index, (coalesce(c1, 0) * {_STRIDE})::INT AS safe_x, (coalesce(r1, 0) * {_STRIDE})::INT AS safe_y,
            least(coalesce(c2 - c1, 1) * {_STRIDE}, 1280 - coalesce(c1, 0) * {_STRIDE})::INT AS safe_w, least(coalesce(r2 - r1, 1) * {_STRIDE}, 720 - coalesce(r1, 0) * {_STRIDE})::INT AS safe_h
        FROM every_frame LEFT JOIN spans USING (job_id, frame_index)
        QUALIFY row_number() OVER (PARTITION BY job_id, frame_index ORDER BY (c2 - c1) * (r2 - r1) DESC NULLS LAST, r2, c2, c1 DESC) = 1"""}

ORACLE: dict[str, str] = {
    "frames_in_scene": with_parts("""SELECT s.job_id, frame_index, ts_ms, s.start_ms AS scene_start, s.end_ms AS scene_end
        FROM scenes s JOIN frames f ON f.job_id = s.job_id AND f.ts_ms BETWEEN s.start_ms AND s.end_ms"""),
    "scene_transcript": with_parts("""SELECT s.job_id, s.start_ms AS scene_start, trim(coalesce(string_agg(t.text, ' ' ORDER BY t.start_ms, t.seg_id), '')) AS transcript,
        substring(trim(coalesce(string_agg(t.text, ' ' ORDER BY t.start_ms, t.seg_id), '')), 1, 1200) AS excerpt
        FROM scenes s LEFT JOIN transcript t ON t.job_id = s.job_id AND t.start_ms >= s.start_ms AND t.start_ms < s.end_ms GROUP BY 1, 2"""),
    "interval_overlap": with_parts("""SELECT s.job_id, kind, v.start_ms, v.end_ms, s.start_ms AS scene_start, s.end_ms AS scene_end FROM scenes s JOIN (
        SELECT job_id, 'speech' AS kind, start_ms, end_ms FROM transcript UNION ALL SELECT job_id, 'silence', start_ms, end_ms FROM silence) v
        ON v.job_id = s.job_id AND v.end_ms > s.start_ms AND v.start_ms < s.end_ms"""),
    "sampled_frames": with_parts("""SELECT DISTINCT job_id, start_ms,
            least(total - 1, CAST(round_even(lo + (hi - lo) * k::DOUBLE / greatest(1, n - 1), 0) AS BIGINT)) AS frame_pos FROM (
        SELECT *, least(5, hi - lo + 1) AS n FROM (SELECT job_id, start_ms, duration_ms * fps // 1000 AS total,
            greatest(0, start_ms * fps // 1000) AS lo, least(duration_ms * fps // 1000 - 1, end_ms * fps // 1000) AS hi
            FROM scenes JOIN jobs USING (job_id)) WHERE total > 0 AND lo <= hi), generate_series(0, n - 1) g(k)"""),
    "stride_samples": with_parts("""SELECT * FROM (SELECT job_id, frame_index, position,
            position % (CASE WHEN ceil(n / 60) <= 60 THEN 60 ELSE ceil(n / 60) END)::BIGINT = 0 AS in_up,
            position % greatest(1, n // 60) = 0 AS in_down, position % 5 = 0 AS in_fixed FROM (
        SELECT job_id, frame_index, row_number() OVER (PARTITION BY job_id ORDER BY frame_index) - 1 AS position,
            count(*) OVER (PARTITION BY job_id) AS n FROM frames)) WHERE in_up OR in_down OR in_fixed"""),
    "rms_levels": """WITH s AS (SELECT o_orderkey // 1000 AS job_id, o_orderkey % 1000 AS i, (o_orderkey * 7919) % 2001 - 1000 AS x FROM orders),
        t AS (SELECT job_id, tick FROM (SELECT job_id, max(i) + 1 AS n FROM s GROUP BY job_id), generate_series(0, n // 4) g(tick))
        SELECT t.job_id, tick, round(sqrt(sum(x * x)::DOUBLE / 10), 6) AS rms FROM t JOIN s ON s.job_id = t.job_id
            AND i >= tick * 4 - 5 AND i < tick * 4 + 5 GROUP BY t.job_id, tick""",
    "silence_intervals": """WITH l AS (SELECT o_orderkey // 500 AS job_id, o_orderkey % 500 AS tick,
            (CASE WHEN (o_orderkey // 7) % 3 = 0 THEN (o_orderkey * 31) % 12 ELSE 500 + (o_orderkey * 17) % 500 END)::DOUBLE AS rms FROM orders),
        q AS (SELECT *, 20 * log10(greatest(rms, 1e-5) / max(rms) OVER (PARTITION BY job_id)) < -40 AS quiet,
            max(tick) OVER (PARTITION BY job_id) AS last_tick, count(*) OVER (PARTITION BY job_id) * 250 + 100 AS track_ms FROM l),
        g AS (SELECT *, tick - row_number() OVER (PARTITION BY job_id ORDER BY tick) AS island FROM q WHERE quiet)
        SELECT job_id, min(tick) * 250 AS start_ms, CASE WHEN max(tick) = any_value(last_tick) THEN any_value(track_ms) ELSE (max(tick) + 1) * 250 END AS end_ms
        FROM g GROUP BY job_id, island HAVING end_ms - start_ms >= 1000""",
    "frame_density": with_parts("SELECT job_id, frame_index, density_e4, objects FROM densities", **DENSITY),
    "safe_area": with_parts("SELECT job_id, frame_index, safe_x, safe_y, safe_w, safe_h FROM areas", **AREA),
    "frame_features": with_parts("""SELECT d.job_id, d.frame_index, d.frame_index * 1000 AS ts_ms, density_e4, objects, safe_x, safe_y, safe_w, safe_h, is_cut,
            n % (CASE WHEN ceil(total / 60) <= 60 THEN 60 ELSE ceil(total / 60) END)::BIGINT = 0 AS in_up,
            n % greatest(1, total // 60) = 0 AS in_down, n % 5 = 0 AS in_fixed
        FROM densities d JOIN areas USING (job_id, frame_index) JOIN turns USING (job_id, frame_index)""", **{**DENSITY, **AREA},
        turns="""SELECT job_id, frame_index, n, total, coalesce(list_sum(list_transform(list_zip(signal, before), lambda z: abs(z[1] * 255.0::DOUBLE - z[2] * 255.0::DOUBLE))) / 64 > 30.0, false) AS is_cut
            FROM (SELECT job_id, frame_index, embedding AS signal, row_number() OVER w - 1 AS n, count(*) OVER (PARTITION BY job_id) AS total, lag(embedding) OVER w AS before
                FROM every_frame JOIN embeddings ON vec_id = (frame_index * 13 + job_id) % (SELECT count(*) FROM embeddings) WINDOW w AS (PARTITION BY job_id ORDER BY frame_index))"""),
    "cut_flags": f"""SELECT b.vec_id // 50 AS job_id, b.vec_id AS frame_index, coalesce({_CUT} > 30.0, false) AS is_cut
        FROM embeddings b LEFT JOIN embeddings a ON a.vec_id = b.vec_id - 1 AND a.vec_id // 50 = b.vec_id // 50""",
}
