"""Registered queries of the corpus operators and their DuckDB statements.

Each query applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm import (embedding_join, language_id, lexical_search, license_scan, line_dedup, mixing, packing, quality, secret_scan, simhash, spelling,
                           url_filter, version_sketch)
from spotweave.llm.common import held_out
from spotweave.session import stage

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))
QUALITY_THRESHOLD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a mix of 1.5 times the corpus takes, sources weighing 5, 2, 1 in turn."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source")
    sized = stage(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"), F.xxhash64("text").alias("digest")), "op1")
    return mixing.mix(sized, text="digest", words="words").select("doc_id", "size", "source_size", "target", "taken")


@_register
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``."""
    pages = _table(spark, sf_dir, "pages", "page_id", "url")
    return (url_filter.filter_urls(pages, url_filter.rule_table(spark, URL_RULES))
            .select("page_id", "host", "path", "rule", "verdict"))


ORACLE["op2_url_filter"] = """
WITH rules(rule_host, rule_path, verdict) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + """),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS row_id FROM cut),
fits AS (
  SELECT row_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (row_id)"""


@_register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(docs.filter(~held_out()), labels.filter(~held_out()))
    return quality.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


@_register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1024 ids; byte_bpe_50k in its rank form, the same ids as the json."""
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False,
                        added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@_register
def op5_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98 within their label."""
    return embedding_join.near_duplicates(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


ORACLE["op5_embedding_join"] = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {embedding_join.COSINE}),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.seen = l.u)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, m.low AS component_id, e.vec_id = m.low AS kept
FROM embeddings e JOIN (SELECT node, min(seen) AS low FROM reach GROUP BY node) m ON m.node = e.vec_id"""


@_register
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in every document with the forest's verdict; values are given as digests."""
    model = secret_scan.fit(secret_scan.labelled_findings(spark))
    return (secret_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text", "source"), model)
            .select("doc_id", "place", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "secret"))


@_register
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash and near-duplicate class of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text")).drop("fp")


@_register
def op8_version_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch fingerprints of every document and of its edited version, and how alike they are."""
    return version_sketch.compare_edits(_table(spark, sf_dir, "documents", "doc_id", "text"))


@_register
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out()))
    return (language_id.identify(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out().alias("held_out"), "lang_pred", "score"))


@_register
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License rules recognised in every document."""
    return license_scan.scan(_table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE["op10_license_scan"] = license_scan.oracle()


@_register
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents share, dropped everywhere but in the first document; texts are given as digests."""
    return (line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents", "doc_id", "text"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")))


ORACLE["op11_line_dedup"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT row_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM lines),
shared AS (
  SELECT key, min(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS})
  GROUP BY key HAVING count(*) >= {line_dedup.MIN_DOCS}),
judged AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS lost FROM keyed k LEFT JOIN shared s USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY row_id"""


@_register
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every item of ``benchmark``."""
    index = lexical_search.build_index(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return lexical_search.search(index, _table(spark, sf_dir, "benchmark", "item_id", "text"))


_RUN = f"regexp_extract_all(translate(text, '{line_dedup.UPPER}', '{line_dedup.LOWER}'), '{lexical_search.TERM}')"
ORACLE["op12_lexical_search"] = f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, {_RUN} AS terms FROM documents WHERE text IS NOT NULL),
counts AS (SELECT row_id, doc_id, len(terms) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM counts),
sized AS (SELECT row_id, doc_id, 25 + (75 * n * big_n) // big_l AS m FROM counts, total),
items AS (SELECT row_number() OVER () AS ask, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT ask, item_id, term, count(*) AS times FROM (SELECT ask, item_id, unnest({_RUN}) AS term FROM items WHERE text IS NOT NULL) GROUP BY ALL),
postings AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, total GROUP BY term),
scores AS (
  SELECT ask, item_id, s.row_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings p USING (term) JOIN sized s ON s.row_id = p.row_id GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, doc_id, row_id) AS place FROM scores WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= {lexical_search.TOP}"""


@_register
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent spelling each is a variant of."""
    words = spelling.damaged_runs(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return spelling.group_variants(spelling.vocabulary(words))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
