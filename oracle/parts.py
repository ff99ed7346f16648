"""Reusable common table expressions for the DuckDB checks (fixture tables and shared steps)."""

from __future__ import annotations

import re

STRETCH = "CASE {0} % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 6 END"
_EVENT_MS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 3600000"


def _s(job: str) -> str:
    return STRETCH.format(job)


PARTS: dict[str, str] = {
    "jobs": f"""SELECT job_id, 720000 * {_s('job_id')} AS duration_ms, 1280 AS width, 720 AS height, 1 AS fps
        FROM (SELECT user_id AS job_id FROM events UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "transcript": f"""SELECT job_id, seg_id, start_ms, start_ms + 1000 + (seg_id * 37) % 7000 AS end_ms,
        seg_id % (SELECT count(*) FROM embeddings) AS vec_id, text FROM (SELECT user_id AS job_id, event_id AS seg_id,
        ({_EVENT_MS}) * {_s('user_id')} AS start_ms, event_type AS text FROM events)""",
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS embedding FROM embeddings",
    "frames_raw": f"""SELECT l_suppkey AS job_id, (l_partkey % 720) * {_s('l_suppkey')} AS frame_index,
        (l_partkey % 720) * {_s('l_suppkey')} * 1000 AS ts_ms, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
        (l_orderkey % 2) * 640 AS safe_x, 86 + (CAST(l_quantity AS INT) % 5) * 80 AS safe_y,
        320 + (l_linenumber % 4) * 107 AS safe_w, 576 - (CAST(l_quantity AS INT) % 5) * 80 AS safe_h,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(round(l_discount * 100) AS INT) * 800 END AS density_e4,
        CASE l_returnflag WHEN 'A' THEN 'bottle, cup' WHEN 'R' THEN 'tv' ELSE '' END AS objects FROM lineitem""",
    "frames": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, frame_index
        ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM frames_raw) WHERE rn = 1""",
    "silence": f"""SELECT job_id, start_ms, start_ms + 500 + o_orderkey % 5000 AS end_ms FROM (
        SELECT o_custkey AS job_id, o_orderkey, ((o_orderkey * 7919) % 720000) * {_s('o_custkey')} AS start_ms
        FROM orders)""",
    "ads": """SELECT concat('ad_', CAST(p_partkey AS VARCHAR)) AS ad_id, p_name AS ad_name,
        CASE WHEN p_partkey % 3 = 0 THEN 'video_clip' ELSE 'banner' END AS ad_type,
        CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 5000 + p_size * 500 ELSE 10000 END AS duration_ms,
        p_type AS ad_category, string_split(p_name, ' ') AS ad_category_path,
        CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 290 WHEN 2 THEN 340 ELSE 500 END AS width, 250 AS height,
        p_partkey % (SELECT count(*) FROM embeddings) AS tgt_vec, concat('C:\\ads\\', p_name, ' ', CAST(p_partkey AS VARCHAR),
            CASE WHEN p_partkey % 3 = 0 THEN '.mp4' ELSE '.jpg' END) AS resource_path
        FROM part""",
    "cats": "SELECT ad_category, min(tgt_vec) AS cat_vec FROM ads GROUP BY ad_category",
    "ce_labels": """SELECT o_custkey AS scene_id, 'ad_' || (o_orderkey % (SELECT count(*) FROM part)) AS ad_id, o_orderkey % (SELECT count(*) FROM part) AS ad_no, (o_orderkey * 7919) % 101 AS score_pct,
        (o_orderkey * 104729) % 1009 AS model_score_i FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderkey % (SELECT count(*) FROM part) ORDER BY o_orderkey) = 1""",
    "decisions": f"""SELECT o_orderkey AS decision_id, o_custkey AS job_id,
        concat('ad_', CAST(o_orderkey % (SELECT count(*) FROM part) AS VARCHAR)) AS ad_id,
        ((o_orderkey * 7919) % 720000) * {_s('o_custkey')} AS start_ms, 5000 + (o_orderkey % 11) * 1000 AS duration_ms,
        20 + o_orderkey % 80 AS score,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 31) % 1000 END AS similarity_e3,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 17) % 1280 END AS x,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 29) % 720 END AS y,
        CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE (o_orderkey * 7) % 500 END AS w,
        CASE WHEN o_orderkey % 23 = 0 THEN 0 ELSE 100 + (o_orderkey * 11) % 400 END AS h,
        o_orderkey % 60 * 500 + 1000 AS scene_ms, (o_orderkey * 13) % 6000 AS density_e4 FROM orders""",
    "feedback": """SELECT doc_id AS decision_id,
        CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS label FROM labels""",
    "playback": """SELECT event_id, ts, user_id AS viewer_id, event_id % 100 AS job_id,
        (event_id * 7919) % 720000 AS pos_ms FROM events""",
    "narratives": "SELECT doc_id AS narrative_id, text FROM documents",
    "detections": f"""SELECT l_suppkey AS job_id, (l_partkey % 720) * {_s('l_suppkey')} AS frame_index,
        ([39, 41, 62, 0, 16, 2])[CAST(l_partkey % 6 AS INT) + 1] AS class_id,
        (['bottle', 'cup', 'tv', 'person', 'dog', 'car'])[CAST(l_partkey % 6 AS INT) + 1] AS class_name,
        CAST(20 + (l_orderkey * 7 + l_linenumber * 13) % 80 AS INT) AS confidence_pct,
        CAST((l_orderkey * 37) % 1300 AS INT) - 60 AS x1, CAST((l_orderkey * 53) % 720 AS INT) - 40 AS y1,
        CAST((l_orderkey * 37) % 1300 + 40 + CAST(l_quantity AS INT) * 9 AS INT) - 60 AS x2,
        CAST((l_orderkey * 53) % 720 + 30 + CAST(l_quantity AS INT) * 7 AS INT) - 40 AS y2 FROM lineitem""",
    "job_files": """SELECT o_orderkey AS job_id,
        CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'analysing' END AS status,
        concat(CASE o_orderkey % 2 WHEN 0 THEN 'D:\\vod\\' ELSE '/srv/vod/' END,
        CASE o_orderkey % 5 WHEN 0 THEN 'SampleVideo_' ELSE 'show ' END, CAST(o_custkey AS VARCHAR), '.E',
        CAST(o_orderkey AS VARCHAR), '.mp4') AS video_path, o_orderdate AS updated_at FROM orders""",
    # --- scenes
    "seg_prev": """SELECT *, lag(end_ms) OVER w AS prev_end, lag(vec_id) OVER w AS prev_vec FROM transcript
        WINDOW w AS (PARTITION BY job_id ORDER BY start_ms, seg_id)""",
    "seg_num": """SELECT s.*, sum(CASE WHEN prev_end IS NULL OR start_ms - prev_end > 4000
            OR list_dot_product(a.embedding, b.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding))
               * sqrt(list_dot_product(b.embedding, b.embedding))) < 0.02 THEN 1 ELSE 0 END)
            OVER (PARTITION BY s.job_id ORDER BY start_ms, seg_id)::BIGINT AS scene_no
        FROM seg_prev s LEFT JOIN vectors a ON a.vec_id = s.prev_vec JOIN vectors b ON b.vec_id = s.vec_id""",
    "scene_groups": """SELECT job_id, scene_no, min(start_ms) AS first_ms, last(end_ms ORDER BY start_ms, seg_id) AS last_end,
            count(*) AS n_segments, first(vec_id ORDER BY start_ms, seg_id) AS ctx_vec,
            string_agg(text, ' ' ORDER BY start_ms, seg_id) AS transcript FROM seg_num GROUP BY ALL""",
    "scenes_raw": """SELECT job_id, scene_no, (CASE WHEN scene_no = 1 THEN 0 ELSE first_ms END)::BIGINT AS start_ms,
            greatest(last_end, coalesce(lead(first_ms) OVER (PARTITION BY job_id ORDER BY scene_no), duration_ms))::BIGINT AS end_ms,
            n_segments, ctx_vec, transcript FROM scene_groups LEFT JOIN jobs USING (job_id)
        UNION ALL SELECT job_id, 1, 0, duration_ms, 0, NULL, '' FROM jobs
            WHERE job_id NOT IN (SELECT job_id FROM transcript)""",
    "scenes": """SELECT * EXCLUDE rn, CASE WHEN ctx_vec % 4 <> 0 THEN (ctx_vec * 7 + 3) % (SELECT count(*) FROM embeddings) ELSE -1 END AS desire_vec FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id, start_ms ORDER BY scene_no DESC) AS rn FROM scenes_raw) WHERE rn = 1""",
    "scene_objects": """SELECT s.*, coalesce((SELECT string_agg(DISTINCT f.objects, ', ' ORDER BY f.objects) FROM frames f
        WHERE f.job_id = s.job_id AND f.ts_ms BETWEEN s.start_ms AND s.end_ms AND f.objects <> ''), '') AS objects FROM scenes s""",
    "scene_ctx": """SELECT s.*, end_ms - start_ms AS scene_ms,
        CASE WHEN end_ms - start_ms < 5000 THEN 0.15 WHEN end_ms - start_ms >= 60000 THEN 0.12
             WHEN objects <> '' AND lower(objects) <> 'none' THEN 0.13 ELSE 0.10 END::DOUBLE AS threshold,
        coalesce(contains(n.text, 'anon'), false) OR coalesce(contains(w.text, 'anon'), false) AS gate_open,
        CASE WHEN contains(n.text, 'reing') THEN 'reing' WHEN contains(n.text, 'attion') THEN 'attion' END AS unsafe_word
        FROM scene_objects s LEFT JOIN narratives n ON n.narrative_id = ctx_vec % (SELECT count(*) FROM documents)
        LEFT JOIN narratives w ON desire_vec >= 0 AND w.narrative_id = desire_vec % (SELECT count(*) FROM documents)""",
    "cosines": """SELECT v.vec_id, a.ad_id, a.tgt_vec,
        greatest(0.0, least(1.0, list_dot_product(v.embedding, t.embedding))) AS sim
        FROM vectors v CROSS JOIN ads a JOIN vectors t ON t.vec_id = a.tgt_vec""",
    "blended": """SELECT c.ctx_vec, c.desire_vec, x.ad_id, x.tgt_vec,
        CASE WHEN d.sim IS NULL THEN x.sim ELSE 0.4 * x.sim + 0.6 * d.sim END AS sim
        FROM (SELECT DISTINCT ctx_vec, desire_vec FROM scenes WHERE ctx_vec IS NOT NULL) c
        JOIN cosines x ON x.vec_id = c.ctx_vec LEFT JOIN cosines d ON d.vec_id = c.desire_vec AND d.ad_id = x.ad_id""",
    "prefiltered": """SELECT s.job_id, s.start_ms, s.end_ms, s.scene_ms, s.threshold, s.unsafe_word, s.ctx_vec, b.ad_id,
            b.tgt_vec, b.sim, a.ad_type, a.duration_ms AS ad_ms, a.ad_category
        FROM scene_ctx s JOIN blended b ON b.ctx_vec = s.ctx_vec AND b.desire_vec = s.desire_vec JOIN ads a USING (ad_id)
        WHERE b.sim >= s.threshold AND NOT (a.ad_type = 'video_clip' AND coalesce(s.scene_ms < a.duration_ms, false))
          AND (s.gate_open OR NOT list_contains(a.ad_category_path, 'ring'))""",
    "topk": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, start_ms ORDER BY sim DESC, ad_id) AS rank
        FROM prefiltered) WHERE rank <= 30""",
    "reranked": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, start_ms
            ORDER BY pair_score DESC, sim DESC, ad_id) AS rerank FROM (
            SELECT t.*, coalesce(p.pair_score, t.sim) AS pair_score FROM topk t LEFT JOIN pair_scores p USING (ctx_vec, ad_id))) WHERE rerank <= 3""",
    "pair_scores": """SELECT l_orderkey % (SELECT count(*) FROM embeddings) AS ctx_vec, 'ad_' || l_partkey AS ad_id,
        max((l_orderkey * 31 + l_linenumber * 17) % 1009) / 1009.0::DOUBLE AS pair_score FROM lineitem GROUP BY ALL""",
    "bonuses": """SELECT v.vec_id AS ctx_vec, c.ad_category, 10 AS bonus FROM vectors v CROSS JOIN cats c
        JOIN vectors t ON t.vec_id = c.cat_vec
        WHERE greatest(0.0, least(1.0, list_dot_product(v.embedding, t.embedding))) >= 0.12""",
    "planned": """SELECT * FROM (SELECT r.*, coalesce(b.bonus, 0) AS category_bonus,
            CASE WHEN ad_type = 'video_clip' AND ad_ms IS NOT NULL THEN ad_ms ELSE least(coalesce(ad_ms, 10000), scene_ms) END AS window_ms,
            CASE WHEN ad_type = 'video_clip' THEN coalesce(nullif(ad_ms, 0), 10000)
                 ELSE least(coalesce(nullif(ad_ms, 0), 10000), scene_ms) END AS overlay_ms,
            CASE WHEN ad_type = 'video_clip' THEN 320 ELSE 300 END AS ad_w,
            CASE WHEN ad_type = 'video_clip' THEN 180 ELSE 250 END AS ad_h
            FROM reranked r LEFT JOIN bonuses b ON b.ctx_vec = r.ctx_vec AND b.ad_category = r.ad_category)
        WHERE end_ms + 500 - start_ms - window_ms >= 0""",
    "requests": "SELECT DISTINCT job_id, start_ms, end_ms, window_ms, ad_w, ad_h FROM planned",
    "win": """SELECT r.*, k, start_ms + 1000 * k AS t, start_ms + 1000 * k + window_ms AS te
        FROM requests r, generate_series(0, (end_ms + 500 - start_ms - window_ms) // 1000) g(k)""",
    "win_frames": """SELECT w.job_id, w.start_ms, w.end_ms, w.window_ms, w.ad_w, w.ad_h, w.k, w.t, w.te, count(*) AS frames,
            sum(coalesce(density_e4, 0))::BIGINT AS density_sum,
            count(*) FILTER (safe_w > 0 AND safe_h > 0) AS safe_frames,
            coalesce(sum(greatest(0, least(20 + ad_w, safe_x + safe_w) - greatest(20, safe_x))
              * greatest(0, least(720 - 20, safe_y + safe_h) - greatest(720 - ad_h - 20, safe_y))) FILTER (safe_w > 0 AND safe_h > 0), 0)::BIGINT AS bl_sum,
            coalesce(sum(greatest(0, least(1280 - 20, safe_x + safe_w) - greatest(1280 - ad_w - 20, safe_x))
              * greatest(0, least(720 - 20, safe_y + safe_h) - greatest(720 - ad_h - 20, safe_y))) FILTER (safe_w > 0 AND safe_h > 0), 0)::BIGINT AS br_sum
        FROM (SELECT r.*, f.ts_ms, f.safe_x, f.safe_y, f.safe_w, f.safe_h, f.density_e4 FROM requests r
              JOIN frames f ON f.job_id = r.job_id AND f.ts_ms BETWEEN r.start_ms AND r.end_ms) rf
        JOIN win w USING (job_id, start_ms, window_ms, ad_w, ad_h)
        WHERE rf.ts_ms BETWEEN w.t AND w.te GROUP BY ALL""",
    "win_speech": """SELECT w.job_id, w.start_ms, w.window_ms, w.ad_w, w.k, w.t, w.te, s.start_ms AS s_start, s.end_ms AS s_end,
            greatest(w.t, max(s.end_ms) OVER (PARTITION BY w.job_id, w.start_ms, w.window_ms, w.ad_w, w.k
                ORDER BY s.start_ms, s.seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prev
        FROM win_frames w JOIN transcript s ON s.job_id = w.job_id AND s.end_ms > w.start_ms AND s.start_ms < w.end_ms
            AND s.end_ms > w.t AND s.start_ms < w.te""",
    "win_gap": """SELECT job_id, start_ms, window_ms, ad_w, k,
            bool_or(s_start - prev >= 2000) OR any_value(te) - greatest(any_value(t), max(s_end)) >= 2000 AS gap
        FROM win_speech GROUP BY ALL""",
    "features": """SELECT w.*, CASE WHEN g.gap IS NOT NULL THEN g.gap
            WHEN w.job_id IN (SELECT job_id FROM transcript) THEN true
            ELSE EXISTS (SELECT 1 FROM silence q WHERE q.job_id = w.job_id AND q.start_ms < w.end_ms AND q.end_ms > w.start_ms
                AND q.start_ms < w.te AND q.end_ms > w.t) END AS quiet,
            CASE WHEN safe_frames > 0 AND greatest(bl_sum, br_sum) > 0
                AND greatest(bl_sum, br_sum) >= 0.5 * w.ad_w * w.ad_h * safe_frames
                THEN CASE WHEN bl_sum >= br_sum THEN 'BL' ELSE 'BR' END END AS corner
        FROM win_frames w LEFT JOIN win_gap g USING (job_id, start_ms, window_ms, ad_w, k)""",
    "scored": """SELECT * EXCLUDE rn FROM (SELECT p.job_id, p.start_ms, p.ad_id, total AS score, p.sim,
            f.density_sum / f.frames / 10000.0 AS avg_density, p.scene_ms,
            p.start_ms + 1000 * f.k + CASE WHEN p.scene_ms >= 30000 THEN 2500 WHEN p.scene_ms >= 10000 THEN 1500 ELSE 500 END AS overlay_start_ms,
            p.overlay_ms, (CASE WHEN f.corner = 'BL' THEN 20 ELSE 1280 - p.ad_w - 20 END)::INT AS x, (720 - p.ad_h - 20)::INT AS y,
            p.ad_w::INT AS w, p.ad_h::INT AS h, f.corner, greatest(bl_sum, br_sum) // safe_frames AS safe_px, f.quiet,
            row_number() OVER (PARTITION BY p.job_id, p.start_ms, p.ad_id ORDER BY total DESC, f.k) AS rn
        FROM planned p JOIN (SELECT * FROM features WHERE corner IS NOT NULL AND density_sum < 6000 * frames) f
            USING (job_id, start_ms, window_ms, ad_w),
        LATERAL (SELECT (CASE WHEN p.sim >= p.threshold THEN trunc(80 * ((p.sim - p.threshold) / (1.0 - p.threshold))) ELSE 0 END
            + p.category_bonus + CASE WHEN f.density_sum <= 3000 * f.frames THEN 25 ELSE 0 END
            + CASE WHEN f.quiet THEN 8 ELSE 0 END)::BIGINT AS total)
        WHERE p.unsafe_word IS NULL) WHERE rn = 1 AND score > 0""",
    "best": """SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY job_id, start_ms ORDER BY score DESC, ad_id) = 1""",
    "best20": "SELECT * FROM best WHERE score >= 20",
    "decided": """SELECT job_id, decision_id, ad_id, start_ms AS overlay_start_ms, duration_ms AS overlay_ms, score FROM decisions""",
}


def with_parts(sql: str, **extra: str) -> str:
    """Prefix ``sql`` with the common table expressions it (transitively) mentions, in order.

    ``extra`` adds query-specific parts on top of the shared ones.
    """
    parts = {**PARTS, **extra}
    names = list(parts)
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, names)) + r")\b")
    needed: dict[str, None] = {}

    def visit(text: str, own: str | None) -> None:
        for name in pattern.findall(re.sub(r"'[^']*'", "''", text)):
            if name != own and name not in needed:
                visit(parts[name], name)
                needed[name] = None

    visit(sql, None)
    if not needed:
        return sql
    recursive = "RECURSIVE " if any("UNION ALL" in parts[n] and f"FROM {n}" in parts[n] for n in needed) else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS MATERIALIZED ({parts[n]})" if n not in recursive_names(parts) else
                                            f"{n} AS ({parts[n]})" for n in needed) + "\n" + sql


def recursive_names(parts: dict[str, str]) -> set[str]:
    return {n for n, body in parts.items() if re.search(rf"\bUNION ALL\b", body) and re.search(rf"\b{n}\b", body)}


_RULES = {
    "overlap": ("i.s >= f.cur_end", "i.score > f.cur_score", "false"),
    "earlier": ("i.s >= f.cur_end", "false", "false"),
    "spacing": ("i.s - f.cur_s >= i.gap",
                "i.s - f.cur_s < i.gap AND i.score > f.cur_score",
                "i.s // 3600000 = f.cur_s // 3600000 AND f.cnt >= 6"),
}


def fold_parts(prefix: str, source: str, rule: str) -> dict[str, str]:
    """Parts ``{prefix}_kept``: the greedy loop replayed item by item with a recursive query.

    ``source`` selects job_id, id, s, dur, score, gap.
    """
    clear, replace, full = _RULES[rule]
    items = f"""SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY s, id) AS n FROM ({source})"""
    walk = f"""SELECT job_id, n, id AS cur_id, s AS cur_s, s + dur AS cur_end, score AS cur_score, 1 AS cnt, 'append' AS act
            FROM {prefix}_items WHERE n = 1
        UNION ALL SELECT i.job_id, i.n,
            CASE a.act WHEN 'skip' THEN f.cur_id ELSE i.id END, CASE a.act WHEN 'skip' THEN f.cur_s ELSE i.s END,
            CASE a.act WHEN 'skip' THEN f.cur_end ELSE i.s + i.dur END, CASE a.act WHEN 'skip' THEN f.cur_score ELSE i.score END,
            CASE WHEN a.act = 'skip' THEN f.cnt WHEN i.s // 3600000 <> f.cur_s // 3600000 THEN 1
                 WHEN a.act = 'append' THEN f.cnt + 1 ELSE f.cnt END, a.act
        FROM {prefix}_walk f JOIN {prefix}_items i ON i.job_id = f.job_id AND i.n = f.n + 1,
        LATERAL (SELECT CASE WHEN {clear} THEN CASE WHEN {full} THEN 'skip' ELSE 'append' END
                             WHEN {replace} THEN 'replace' ELSE 'skip' END AS act) a"""
    kept = f"""SELECT w.job_id, w.cur_id AS id FROM {prefix}_walk w LEFT JOIN {prefix}_walk x ON x.job_id = w.job_id AND x.n = w.n + 1
        WHERE x.act IS NULL OR x.act = 'append'"""
    return {f"{prefix}_items": items, f"{prefix}_walk": walk, f"{prefix}_kept": kept}
