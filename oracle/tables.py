"""DuckDB statements for the source, table and text queries."""

from __future__ import annotations

from oracle.parts import with_parts

_WS = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _section(label: str) -> str:
    lines = (r"list_filter(list_transform(regexp_split_to_array(answer, '\r\n|[\n\r\v\f\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'), "
             f"lambda l: {_strip('l')}), lambda l: starts_with(l, '{label}'))")
    return f"coalesce({_strip(f'substring({lines}[-1], 4)')}, '')"


_ANSWERS = """SELECT doc_id, concat('  상황:', source, ' ', lang, chr(10), text, chr(10), '감정: ', lang,
    CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '욕구:  ', n_chars, '  ') ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), ' 상황: ', text) ELSE '' END) AS answer FROM documents"""


def _clean(x: str) -> str:
    """Line by line: marks off the front, lines put side by side, wide gaps closed."""
    front = rf"^{_WS}*(#{{1,6}}{_WS}+)?{_WS}*([-•]{_WS}+)?{_WS}*(\p{{Nd}}+\.{_WS}+)?"
    bare = f"regexp_replace({x}, '\\*+([^*\n]+)\\*+', '\\1', 'g')"
    lines = f"list_transform(string_split({bare}, chr(10)), lambda l: regexp_replace(l, '{front}', ''))"
    return _strip(f"regexp_replace(array_to_string({lines}, ' '), '{_WS}{{2,}}', ' ', 'g')")


_BASE = "string_split(replace(resource_path, '\\', '/'), '/')[-1]"
_TITLE = "lower(trim(regexp_replace(string_split({0}, '.')[1], '[-_]', ' ', 'g')))"

ORACLE: dict[str, str] = {
    "timeline_scan": with_parts(
        """SELECT job_id, 'frame' AS kind, round(ts_ms / 1000.0::DOUBLE, 3) AS start_sec, round(ts_ms / 1000.0::DOUBLE, 3) AS end_sec, objects AS label FROM frames
        UNION ALL SELECT job_id, 'silence', round(start_ms / 1000.0::DOUBLE, 3), round(end_ms / 1000.0::DOUBLE, 3), '' FROM silence
        UNION ALL SELECT job_id, 'speech', round(start_ms / 1000.0::DOUBLE, 3), round(end_ms / 1000.0::DOUBLE, 3), trim(text) FROM transcript WHERE trim(text) <> ''"""),
    "asset_catalog": """WITH f AS (SELECT concat(p_name, ' ', CAST(p_partkey // 2 AS VARCHAR)) AS ad_id, p_size % 4 AS k,
            concat(CASE p_partkey % 2 WHEN 0 THEN 'D:\\ads\\' ELSE '/srv/ads/' END, p_name, ' ', CAST(p_partkey // 2 AS VARCHAR),
            CASE p_size % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.jpg' ELSE '.png' END) AS resource_path, p_size * 0.5::DOUBLE AS sec
            FROM part WHERE p_size % 4 < 3)
        SELECT ad_id, CASE k WHEN 0 THEN 'video_clip' ELSE 'banner' END AS ad_type, resource_path,
            CASE k WHEN 0 THEN sec ELSE 10.0::DOUBLE END AS duration_sec FROM f
        WHERE ad_id NOT IN (SELECT concat(p_name, ' ', CAST(p_partkey // 4 AS VARCHAR)) FROM part)
        QUALIFY row_number() OVER (PARTITION BY ad_id ORDER BY k, resource_path) = 1""".replace("\\\\", "\\"),
    "lineup_items": with_parts(
        """SELECT c_nationkey AS channel, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 8 ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS pos,
            CAST(c_custkey AS VARCHAR) AS id, c_name AS title, concat(c_name, '.E01') AS filename, concat('posters/', c_name, '.jpg') AS poster,
            'previews/' AS preview, concat('thumbnails/', c_mktsegment, '.jpg') AS thumbnail, '' AS job_id
        FROM customer WHERE c_nationkey % 5 <> 0
        UNION ALL SELECT CAST(job_id % 25 AS INT), NULL, CAST(job_id AS VARCHAR), regexp_replace(b, '\\.[^.]+$', ''), b, '', '', '', CAST(job_id AS VARCHAR)
        FROM (SELECT job_id, string_split(replace(video_path, '\\', '/'), '/')[-1] AS b FROM job_files WHERE status = 'complete')
        WHERE job_id % 25 NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 5 <> 0)"""),
    "replace_by_job": with_parts(
        """SELECT decision_id, job_id, ad_id, score FROM decisions WHERE job_id % 3 <> 0
        UNION ALL SELECT decision_id, job_id, ad_id, score + 1000 FROM decisions WHERE job_id % 3 = 0 AND score >= 50"""),
    "insert_if_absent": with_parts(
        """SELECT DISTINCT job_id, start_ms, end_ms, CASE WHEN start_ms % 2 = 0 THEN 'stored' ELSE 'new' END AS batch FROM silence"""),
    "upsert_latest": with_parts(
        """SELECT scene_id, ad_id, CASE WHEN ad_no % 3 <> 0 THEN 'stored' ELSE 'new' END AS context,
            CASE WHEN ad_no % 2 = 0 OR ad_no % 3 = 0 THEN (score_pct + (ad_no % 3 + 1) * 7) % 101 ELSE score_pct END AS score_pct,
            CASE WHEN ad_no % 2 = 0 OR ad_no % 3 = 0 THEN ad_no % 3 + 1 ELSE 0 END AS revision
        FROM ce_labels"""),
    "scene_context_update": with_parts(
        """SELECT decision_id, job_id, CASE WHEN f.label IS NULL THEN ad_id WHEN f.label = 0 THEN NULL
            ELSE concat('ad_', f.label) END AS ad_id, score FROM decisions LEFT JOIN feedback f USING (decision_id)"""),
    "dedupe_frames": with_parts("SELECT job_id, frame_index, l_orderkey, l_linenumber, density_e4, objects FROM frames"),
    "pending_jobs": with_parts(
        """SELECT job_id FROM (SELECT s_suppkey AS job_id FROM supplier UNION SELECT job_id FROM jobs)
        WHERE job_id NOT IN (SELECT job_id FROM frames WHERE objects = 'tv' AND density_e4 >= 7200)"""),
    "pending_scenes": """SELECT o_orderkey AS scene_id, o_custkey AS job_id, 'missing' AS run FROM orders
        WHERE o_orderkey NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT o_orderkey, o_custkey, 'forced' FROM orders WHERE o_orderkey >= 500""",
    "pending_ads": with_parts(
        """SELECT ad_id, ad_name, 'missing' AS run FROM ads WHERE tgt_vec % 3 IN (0, 1)
        UNION ALL SELECT ad_id, ad_name, 'forced' FROM ads WHERE ad_id >= 'ad_150'"""),
    "scene_sections": f"""SELECT doc_id, {_section('상황:')} AS situation, {_section('감정:')} AS emotion,
        {_section('욕구:')} AS desire FROM ({_ANSWERS})""",
    "clean_narrative": f"""SELECT doc_id, {_clean('t')} AS narrative FROM (SELECT doc_id, concat('## ', source, chr(10),
        '- **', lang, '** and *', lang, '*', chr(10), text, chr(10), '  12. end') AS t FROM documents)""",
    "keyword_tags": f"""SELECT doc_id, coalesce(n, 0)::INT AS n_tags, coalesce(tags, '') AS tags FROM documents LEFT JOIN (
        SELECT doc_id, count(*) AS n, string_agg(tag, '|' ORDER BY pos) AS tags FROM (
            SELECT doc_id, tag, min(pos) AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS rn FROM (
                SELECT doc_id, lower({_strip('unnest(string_split(replace(text, chr(10), chr(44)), chr(44)))')}) AS tag,
                       generate_subscripts(string_split(replace(text, chr(10), chr(44)), chr(44)), 1) AS pos FROM documents)
            WHERE length(tag) BETWEEN 1 AND 40 AND len(regexp_split_to_array(tag, '{_WS}+')) <= 3 GROUP BY doc_id, tag)
        WHERE rn <= 12 GROUP BY doc_id) USING (doc_id)""",
    "parsed_scores": with_parts(
        """SELECT scene_id, ad_id, round(score, 6) AS score FROM (SELECT scene_id, ad_id, TRY_CAST(trim(raw, ' ' || chr(10)) AS DOUBLE) AS score FROM (
        SELECT scene_id, ad_id, CASE ad_no % 7 WHEN 0 THEN concat(' ', CAST(score_pct / 100.0::DOUBLE AS VARCHAR), chr(10))
            WHEN 1 THEN 'n/a' WHEN 2 THEN '' WHEN 3 THEN concat('-0.', score_pct + 1) WHEN 4 THEN concat(score_pct, '.5')
            WHEN 5 THEN concat(score_pct, 'e-2') ELSE concat('0.', score_pct) END AS raw FROM ce_labels))
        WHERE score BETWEEN 0 AND 1"""),
    "label_bands": with_parts(
        """SELECT scene_id, ad_id, CASE WHEN score_pct >= 70 THEN 'positive' WHEN score_pct <= 30 THEN 'negative'
        ELSE 'ambiguous' END AS label FROM ce_labels"""),
    "resource_urls": with_parts(
        f"""SELECT ad_id, concat('http://api/media/ads/', CASE ad_type WHEN 'video_clip' THEN 'videos' ELSE 'images' END, '/', {_BASE}) AS ad_url,
        concat('http://api/media/source/', url_encode({_BASE})) AS source_url,
        concat(CASE ad_type WHEN 'video_clip' THEN '/mnt/videos/' ELSE '/mnt/images/' END, {_BASE}) AS mounted FROM ads"""),
    "title_match": f"""WITH f AS (SELECT p_partkey AS file_id, {_TITLE.format("concat(replace(p_name, ' ', '_'), CASE p_partkey % 3 WHEN 0 THEN concat('-', p_brand) ELSE '' END, '.E')")} AS t FROM part),
        i AS (SELECT p_partkey AS list_pos, concat(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' poster')
            WHEN 2 THEN upper(p_name) ELSE concat(p_brand, ' ', p_type) END, '.jpg') AS image FROM part),
        k AS (SELECT list_pos, {_TITLE.format('image')} AS s FROM i),
        m AS (SELECT t, min(list_pos) AS list_pos FROM (SELECT DISTINCT t FROM f) JOIN (SELECT s, min(list_pos) AS list_pos FROM k GROUP BY s)
            ON contains(t, s) OR contains(s, t) GROUP BY t)
        SELECT file_id, list_pos, image FROM f LEFT JOIN m USING (t) LEFT JOIN i USING (list_pos)""",
}
