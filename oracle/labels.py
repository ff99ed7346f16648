"""DuckDB statements for the label, split, training-set and evaluation queries."""

from __future__ import annotations

from oracle.parts import with_parts

def _hash(*ids: str) -> str:
    """The seeded draw of ids, below 1,000,003."""
    return f"('0x' || substr(md5(concat_ws(':', 42, {', '.join(ids)})), 1, 12))::BIGINT % 1000003"

_PARTS = {
    "labelled": """SELECT *, score_pct / 100.0::DOUBLE AS score, CASE WHEN score_pct >= 70 THEN 'positive' WHEN score_pct <= 30 THEN 'negative'
        ELSE 'ambiguous' END AS label FROM ce_labels""",
    "waiting": f"""SELECT scene_id, row_number() OVER (ORDER BY {_hash('scene_id')}, scene_id) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT scene_id FROM labelled WHERE scene_id % 7 <> 0)""",
    "split_rows": """SELECT l.*, CASE WHEN scene_id % 7 = 0 THEN 'train' WHEN rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split
        FROM labelled l LEFT JOIN waiting USING (scene_id)""",
    "train_rows": f"""SELECT scene_id, ad_id, label, score FROM split_rows WHERE split = 'train' AND label = 'positive'
        UNION ALL SELECT scene_id, ad_id, label, score FROM (SELECT *, row_number() OVER (ORDER BY {_hash('scene_id', 'ad_id')}, scene_id, ad_id) AS rn FROM split_rows
            WHERE split = 'train' AND label <> 'positive' AND score <= 0.5)
        WHERE rn <= 3 * (SELECT count(*) FROM split_rows WHERE split = 'train' AND label = 'positive')""",
    "scenes_in": "SELECT c_custkey AS scene_id FROM customer WHERE c_mktsegment <> '' AND c_custkey % 4 <> 0",
    "ads_in": "SELECT 'ad_' || p_partkey AS ad_id FROM part WHERE p_name <> '' AND p_partkey % 5 <> 0",
    "both_sides": """SELECT scene_id, count(*) FILTER (label = 'positive') AS n_positive, count(*) FILTER (label = 'negative') AS n_negative
        FROM labelled GROUP BY scene_id HAVING n_positive > 0 AND n_negative > 0""",
    "held": f"""SELECT scene_id FROM (SELECT scene_id, row_number() OVER (ORDER BY {_hash('scene_id')}, scene_id) AS rn, count(*) OVER () AS n
        FROM both_sides) WHERE rn <= greatest(1, ceil(n * 0.2::DOUBLE))""",
    "model_rows": """SELECT model, scene_id, ad_id, label = 'positive' AS positive, score AS relevance,
            CASE model WHEN 'base' THEN model_score_i / 1009 ELSE (score_pct * 5 + model_score_i) / 1514 END AS s
        FROM labelled CROSS JOIN (VALUES ('base'), ('tuned')) v(model) WHERE label <> 'ambiguous' AND scene_id IN (SELECT scene_id FROM held)""",
    "ranked_rows": """SELECT *, row_number() OVER (PARTITION BY model, scene_id ORDER BY s DESC, ad_id) AS r,
        row_number() OVER (PARTITION BY model, scene_id ORDER BY relevance DESC, ad_id) AS q FROM model_rows""",
    "per_scene": """SELECT model, scene_id, coalesce(1.0 / min(r) FILTER (positive), 0) AS rr, count(*) FILTER (positive AND r <= 10) / 10 AS p,
        sum(relevance / log2(r + 1)) FILTER (r <= 10) AS dcg, sum(relevance / log2(q + 1)) FILTER (q <= 10) AS ideal FROM ranked_rows GROUP BY ALL""",
    "per_model": """SELECT model, round(avg(rr), 4) AS mrr, round(avg(p), 4) AS precision_at_k,
        round(avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END), 4) AS ndcg FROM per_scene GROUP BY model""",
}


def _sql(text: str) -> str:
    return with_parts(text, **_PARTS)


ORACLE: dict[str, str] = {
    "training_features": _sql("""SELECT similarity_e3 / 1000.0::DOUBLE AS similarity_score, score AS final_score, scene_ms / 1000.0::DOUBLE AS scene_duration_sec,
        a.duration_ms / 1000.0::DOUBLE AS ad_duration_sec, density_e4 / 10000.0::DOUBLE AS avg_density, ad_type, label
        FROM feedback JOIN decisions d USING (decision_id) JOIN ads a USING (ad_id) WHERE similarity_e3 IS NOT NULL"""),
    "unlabelled_pairs": _sql("""SELECT scene_id, count(*) FILTER (l.ad_id IS NOT NULL) AS n_labelled, count(*) FILTER (l.ad_id IS NULL) AS n_unlabelled
        FROM scenes_in s CROSS JOIN ads_in a LEFT JOIN ce_labels l USING (scene_id, ad_id) GROUP BY scene_id"""),
    "sampled_pairs": _sql(f"""SELECT scene_id, ad_id, pick::INT AS pick FROM (SELECT scene_id, ad_id, row_number() OVER (PARTITION BY scene_id
            ORDER BY (place - {_hash('scene_id')} % m + m) % m) AS pick
        FROM scenes_in CROSS JOIN (SELECT ad_id, row_number() OVER (ORDER BY {_hash('ad_id')}, ad_id) - 1 AS place, count(*) OVER () AS m FROM ads_in)
        ANTI JOIN ce_labels USING (scene_id, ad_id)) WHERE pick <= 3"""),
    "scene_split": _sql("SELECT scene_id, ad_id, label, split FROM split_rows"),
    "training_set": _sql("SELECT scene_id, ad_id, label, round(score, 6) AS score FROM train_rows"),
    "eval_groups": _sql("""SELECT scene_id, ad_id, label = 'positive' AS positive,
            count(*) FILTER (label = 'positive') OVER w AS n_positive, count(*) FILTER (label = 'negative') OVER w AS n_negative
        FROM split_rows WHERE split = 'test' AND label <> 'ambiguous' WINDOW w AS (PARTITION BY scene_id)
        QUALIFY n_positive > 0 AND n_negative > 0"""),
    "eval_holdout": _sql("SELECT scene_id FROM held"),
    "rank_metrics": _sql("""SELECT metric, b AS base, t AS tuned, round(t - b, 4) AS improvement FROM (
        SELECT 'mrr' AS metric, max(mrr) FILTER (model = 'base') AS b, max(mrr) FILTER (model = 'tuned') AS t FROM per_model
        UNION ALL SELECT 'precision_at_k', max(precision_at_k) FILTER (model = 'base'), max(precision_at_k) FILTER (model = 'tuned') FROM per_model
        UNION ALL SELECT 'ndcg', max(ndcg) FILTER (model = 'base'), max(ndcg) FILTER (model = 'tuned') FROM per_model)"""),
    "score_histogram": _sql("""SELECT (score_pct + 5) // 10 / 10.0::DOUBLE AS score_bucket, count(*) AS cnt FROM labelled
        WHERE label = 'ambiguous' GROUP BY 1"""),
    "relabel_band": _sql("""SELECT scene_id, ad_id, CASE WHEN hit THEN 'positive' ELSE label END AS label, CASE WHEN NOT hit THEN split END AS split,
        CASE WHEN NOT hit AND ad_no % 2 = 0 THEN 1 END AS trained FROM (SELECT *, score_pct BETWEEN 60 AND 69 AS hit FROM split_rows)"""),
    "label_distribution": _sql("""SELECT 'feedback' AS kind, CAST(label AS VARCHAR) AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
        FROM feedback GROUP BY label UNION ALL SELECT 'band', label, count(*), round(count(*) / sum(count(*)) OVER (), 6) FROM labelled GROUP BY label"""),
    "training_run": _sql("""SELECT count(*) FILTER (split = 'test' AND label <> 'ambiguous') AS test_count,
        count(*) FILTER (split = 'train') AS marked_count, (SELECT count(*) FROM train_rows) AS train_count FROM split_rows"""),
    "trained_marks": _sql("""SELECT scene_id, ad_id, split, CASE WHEN split = 'train' THEN 2 WHEN ad_no % 2 = 0 THEN 1 END::BIGINT AS trained FROM split_rows"""),
    "test_evaluation": with_parts("""SELECT metric, b AS base, t AS tuned, round(t - b, 4) AS improvement, (SELECT max(n_scenes) FROM per_model) AS n_scenes FROM (
        SELECT 'mrr' AS metric, max(mrr) FILTER (model = 'base') AS b, max(mrr) FILTER (model = 'tuned') AS t FROM per_model
        UNION ALL SELECT 'precision_at_k', max(precision_at_k) FILTER (model = 'base'), max(precision_at_k) FILTER (model = 'tuned') FROM per_model
        UNION ALL SELECT 'ndcg', max(ndcg) FILTER (model = 'base'), max(ndcg) FILTER (model = 'tuned') FROM per_model)""", **{
        **_PARTS, "model_rows": _PARTS["model_rows"].replace("FROM labelled", "FROM split_rows").replace("scene_id IN (SELECT scene_id FROM held)",
            """split = 'test' AND scene_id IN (SELECT scene_id FROM split_rows WHERE split = 'test' GROUP BY scene_id
                HAVING bool_or(label = 'positive') AND bool_or(label = 'negative'))"""),
        "per_model": _PARTS["per_model"].replace("AS ndcg", "AS ndcg, count(*) AS n_scenes")}),
    "threshold_quality": _sql("""SELECT th::DOUBLE AS threshold,
        round(count(*) FILTER (label = 'positive' AND model_score_i / 1009 >= th) / count(*) FILTER (label = 'positive'), 6) AS recall,
        round(count(*) FILTER (label = 'negative' AND model_score_i / 1009 >= th) / count(*) FILTER (label = 'negative'), 6) AS false_positive_rate
        FROM labelled CROSS JOIN (VALUES (0.25), (0.30), (0.35), (0.40)) v(th) GROUP BY th"""),
    "threshold_sweep": _sql("""SELECT th::DOUBLE AS threshold, count(*) FILTER (sim >= th) AS kept, round(avg(sim) FILTER (sim >= th), 6) AS avg_sim,
        round(1 - count(*) FILTER (sim >= th) / count(*) FILTER (sim >= 0.12), 6) AS drop_rate
        FROM scenes JOIN blended USING (ctx_vec, desire_vec) CROSS JOIN (VALUES (0.10), (0.12), (0.15), (0.20)) v(th) GROUP BY th"""),
    "similarity_stats": _sql("""SELECT count(*) AS n_decisions, count(similarity_e3) AS n_with_similarity,
        round(sum(similarity_e3) / count(similarity_e3) / 1000, 3) AS avg_similarity, min(similarity_e3) / 1000 AS min_similarity,
        max(similarity_e3) / 1000 AS max_similarity, round(sum(score) / count(score), 0) AS avg_score, (SELECT count(*) FROM ads) AS ads_total,
        (SELECT count(*) FROM ads WHERE tgt_vec % 3 <> 0) AS ads_filled, (SELECT count(*) FROM ads WHERE tgt_vec % 3 = 0) AS ads_missing FROM decisions"""),
}
