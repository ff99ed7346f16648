"""Line dedup: lines that many documents share are dropped, DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits; distinct documents are counted per hash; lines over
the threshold are dropped and the rest of each document is put together again by position. A line in very many
documents costs one row per task on its way to the count, and adaptive execution splits its rows where the counts come back.
Texts move once, to meet the positions they lose; lines travel as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import keep_columns, named
from spotweave.session import stage

MIN_DOCS = 2
MIN_CHARS = 10
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lost_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(``doc``, ``digest``, ``lost``): positions from 0 that a text loses; ``digest`` is the 64-bit hash of the text.

    Only texts that lose a line have a row. Rows with equal id and text share theirs.
    """
    body = named(text)
    lines = (docs.select(named(key).alias("doc"), F.xxhash64(body).alias("digest"), F.posexplode(_lines(body)).alias("place", "line"))
             .select("doc", "digest", "place", line_key(F.col("line")).alias("line"))
             .filter(F.length("line") >= min_chars)
             # Chained hashes collide together, so the second one starts from another seed.
             .select("doc", "digest", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line").alias("h2")))
    held = lines.select("h1", "h2", "doc").distinct()
    # Written, so that the join has a plain shuffle on either side and the rows of a line in very many documents can be split.
    shared = stage(held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("keeper"))
                   .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "shared-lines")
    return (lines.join(shared, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
            .groupBy("doc", "digest").agg(F.collect_set("place").alias("lost")))


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                      min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` freed of the lines it shares, and ``n_lines`` (before) and ``n_dropped`` (long).

    A line is what lies between line breaks; its key is :func:`line_key`. Keys of at least ``min_chars`` code points
    found in at least ``min_docs`` documents lose all their lines but those of the smallest id that holds the key (which keeps repeats).
    A document is an id: rows that repeat an id are one document, and rows without id are together one document that
    comes after all others. A null or empty text is one empty line and gives an empty text; a text that loses all lines becomes empty.
    Every row stays, repeated ones too, and so does an empty table; columns named as the new ones are replaced.
    """
    body, kept = named(text), [c for c in docs.columns if c not in OUT]
    lost = lost_lines(docs, key, text, min_docs, min_chars)
    rows = docs.select(keep_columns(docs, text, *OUT).alias("_row"), named(key).alias("_doc"), F.xxhash64(body).alias("_digest"), body.alias("_text"))
    lines, n = _lines(F.col("_text")), F.size(_lines(F.col("_text")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "lost"), lambda i: F.get(F.col("_lines"), i))
    return (rows.join(lost, F.col("_doc").eqNullSafe(F.col("doc")) & (F.col("_digest") == F.col("digest")), "left")
            .withColumn("_lines", lines)
            .select(*[F.when(F.col("lost").isNull(), F.coalesce("_text", F.lit(""))).otherwise(F.array_join(left, "\n")).alias(c)
                      if c == text else F.col("_row")[c].alias(c) for c in kept],
                    F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped")))
