"""URL rules by host suffix and path prefix, looked up by digest prefix.

Every url is expanded into the (host suffix, path prefix) expressions that a rule could have, the
expressions are joined to the rules on a short prefix of their SHA-256 digest, full digests confirm
the match and the longest rule wins. Only expressions of a shape that some rule has (number of host
labels, length of path) are made, so their number per url does not depend on the url's length.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spotweave.llm.common import keep_columns

RULE_SCHEMA = "rule_host string, rule_path string, rule_verdict string"
PREFIX_HEX = 8  # 32 bits


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(_after_scheme(url), r"\A[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, allow or block) as a table for :func:`filter_urls`."""
    return spark.createDataFrame(list(rules), RULE_SCHEMA)


def _digest(host: Column, path: Column) -> Column:
    # The length keeps host and path apart.
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    A rule fits its host and every subdomain whose path starts with the rule's path. The longest
    rule (host and path together) wins, then the longer host, then block over allow, then the
    smaller text. Repeated rules count once; rules with a null or an empty host are left out. Without
    a fitting rule the verdict is ``default``. A null url, or one without ``://``, has an empty host
    and path. Every input row gives one row; columns of these four names are replaced.

    Each distinct url is expanded and looked up once, so repeated urls cost one lookup; the lookup
    table is joined back by url. Both joins are plain equi-joins: small sides are broadcast by
    their measured size, large skewed ones are split at run time.
    """
    wanted = (rules.filter((F.col("rule_host") != "") & F.col("rule_path").isNotNull() & F.col("rule_verdict").isNotNull())
              .select("rule_host", "rule_path", "rule_verdict", F.size(F.split("rule_host", r"\.")).alias("labels"),
                      F.length("rule_path").alias("path_length")).distinct())
    shapes = wanted.agg(F.collect_set(F.struct("labels", "path_length")).alias("shapes")).scalar()
    keyed_rules = wanted.withColumn("full", _digest(F.col("rule_host"), F.col("rule_path"))).select(
        F.substring("full", 1, PREFIX_HEX).alias("short"), F.col("full").alias("rule_full"),
        F.concat("rule_host", "rule_path").alias("_rule"), F.col("rule_verdict").alias("_verdict"),
        F.length("rule_host").alias("host_length"))

    urls = pages.select(F.col(url).alias("_url")).filter(F.col("_url").contains("://")).distinct()
    expressions = (urls.select("_url", url_host(F.col("_url")).alias("h"), url_path(F.col("_url")).alias("p"))
                   .withColumn("shape", F.explode(shapes))
                   .filter((F.size(F.split("h", r"\.")) >= F.col("shape.labels")) & (F.length("p") >= F.col("shape.path_length")))
                   .select("_url", F.expr("substring_index(h, '.', -shape.labels)").alias("suffix"),
                           F.expr("substring(p, 1, shape.path_length)").alias("prefix"))
                   .withColumn("full", _digest(F.col("suffix"), F.col("prefix")))
                   .select("_url", "full", F.substring("full", 1, PREFIX_HEX).alias("short")))
    winners = (expressions.join(keyed_rules, "short").filter(F.col("full") == F.col("rule_full"))
               .groupBy("_url").agg(F.max(F.struct(
                   F.length("_rule").alias("size"), "host_length", (F.col("_verdict") == "block").alias("hard"),
                   F.struct(F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict")).alias("found"))).alias("best"))
               .select("_url", F.col("best.found.rule").alias("_rule"), F.col("best.found.verdict").alias("_verdict")))
    row, link = keep_columns(pages, "host", "path", "rule", "verdict"), F.col("_url")
    return (pages.select(row.alias("_row"), F.col(url).alias("_url")).join(winners, "_url", "left")
            .select("_row.*", url_host(link).alias("host"), url_path(link).alias("path"),
                    F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(default)).alias("verdict")))
