"""Ranked lexical search over a length-stratified index.

Documents with equal length normaliser m are a stratum, kept in parts of bounded size. The postings of a term in a part are
grouped by its number of occurrences tf, so an impact is worked out once per (m, tf) and added to a whole list.
The largest tf of its terms bounds what an item can score in a part: the parts of highest bound are visited first, and
of the others only those whose bound reaches the score that the first visit guarantees.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spotweave.llm.common import named
from spotweave.session import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
PART_DOCS = 4096
PART_TERMS = 1 << 20  # distinct terms of all documents of a part; a single document may have more
FIRST_PARTS = 4  # parts an item visits before its threshold is known
SLICE_ITEMS = 4096  # items that meet a part in one group
_TERMS = re.compile(TERM)


class Index(NamedTuple):
    """A written index. ``postings``: m, part, term, tf, top (is it the term's largest tf there), places (array); ``parts``: m, part, ids by
    place; ``docs`` and ``terms`` are N and L."""

    postings: DataFrame
    parts: DataFrame
    docs: int
    terms: int


def term_counts(text: str | None) -> Counter:
    """Occurrences of each term of a whole text, A-Z in lower case."""
    return Counter(_TERMS.findall((text or "").encode("utf-8", "replace").lower().decode("utf-8")))


def _counted(rows: DataFrame, kind: str) -> DataFrame:
    """(id, text) to id, n (terms with repeats), terms, tfs."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [term_counts(t.as_py()) for t in batch.column(1)]
            # Built flat: one list of terms and one of numbers for the documents of a batch.
            bounds = pa.array(np.concatenate(([0], np.cumsum([len(c) for c in counts]))), pa.int32())
            terms = pa.array([t for c in counts for t in c], pa.string())
            tfs = pa.array(np.fromiter((n for c in counts for n in c.values()), np.int64, len(terms)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.total() for c in counts], pa.int64()), pa.ListArray.from_arrays(bounds, terms), pa.ListArray.from_arrays(bounds, tfs)],
                names=["id", "n", "terms", "tfs"])

    return rows.mapInArrow(work, f"id {kind}, n long, terms array<string>, tfs array<long>")


def normaliser(n: Column, docs: int, terms: int) -> Column:
    """100 - 75 + (75 * n * N) div L, in decimals on the way, which a large corpus needs."""
    wide = F.lit(75).cast("decimal(4,0)") * n.cast("decimal(16,0)") * F.lit(docs).cast("decimal(16,0)")
    return F.lit(25) + F.call_function("div", wide, F.lit(max(terms, 1)).cast("decimal(18,0)"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", part_docs: int = PART_DOCS, part_terms: int = PART_TERMS) -> Index:
    """Index of all terms of the whole texts of all rows of ``docs`` (ids are read as long).

    Null texts and texts without a term are in no stratum; a row with a repeated or null id is a document of its own; other columns are
    ignored. A stratum is dealt to as many groups as its terms need, so a normaliser that a third of all documents have goes to many
    tasks, and a task holds one part at a time.
    """
    forward = stage(_counted(docs.select(named(key).cast("long").alias("id"), named(text).alias("text")), "long"), "lexical-forward").filter("n > 0")
    total = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # Every attempt reads the written files in the same splits, so a row keeps its number.
    placed = forward.withColumns({"m": normaliser(F.col("n"), total["docs"], total["terms"]), "row": F.monotonically_increasing_id()})
    # A stratum is dealt out by its terms, so that neither one normaliser nor the longest documents make a long task.
    # Written, so that its size is known and the documents need not be shuffled to meet it.
    shares = stage(placed.groupBy("m").agg(F.ceil(F.sum("n") / part_terms).alias("shares")), "lexical-shares")
    strata = (placed.join(shares, "m").withColumn("share", F.pmod("row", "shares"))
              .repartition("m", "share").sortWithinPartitions("m", "share", F.col("id").asc_nulls_last())
              .select("id", "terms", "tfs", "m", "share"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        docs_held = terms_held = 0
        last = None
        for batch in batches:
            begin, ms = 0, list(zip(batch.column("m").to_pylist(), batch.column("share").to_pylist()))
            sizes = np.diff(batch.column("terms").offsets.to_numpy()).tolist()
            for i, m in enumerate(ms):
                if docs_held and (m != last or docs_held >= part_docs or terms_held + sizes[i] > part_terms):
                    yield _invert([*held, batch.slice(begin, i - begin)], last[0], task + number)
                    held, begin, number, docs_held, terms_held = [], i, number + 1, 0, 0
                docs_held, terms_held, last = docs_held + 1, terms_held + sizes[i], m
            held.append(batch.slice(begin))
        if docs_held:
            yield _invert(held, last[0], task + number)

    table = stage(strata.mapInArrow(work, "m long, part long, term string, tf long, top boolean, places array<int>, ids array<long>"), "lexical-index")
    return Index(table.filter(F.col("term").isNotNull()).drop("ids"), table.filter(F.col("term").isNull()).select("m", "part", "ids"),
                 total["docs"], total["terms"])


def _invert(rows: list[pa.RecordBatch], m: int, part: int) -> pa.RecordBatch:
    """Postings of one part, its documents of each (term, tf) by place, and a last row with the ids of the places."""
    table = pa.Table.from_batches(rows).combine_chunks()
    lists = table.column("terms").combine_chunks()
    coded = lists.flatten().dictionary_encode()
    code, tf = coded.indices.to_numpy().astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy()
    place = np.repeat(np.arange(len(table), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    order = np.lexsort((place, -tf, code))
    code, tf, place = code[order], tf[order], place[order]
    new_term = np.concatenate(([True], np.diff(code) != 0))
    starts = np.flatnonzero(new_term | np.concatenate(([True], np.diff(tf) != 0)))
    n = len(starts)
    ids = table.column("id").combine_chunks()
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n + 1, m, np.int64)), pa.array(np.full(n + 1, part, np.int64)),
        pa.array([*coded.dictionary.take(pa.array(code[starts])).to_pylist(), None], pa.string()),
        pa.array(np.append(tf[starts], 0)), pa.array(np.append(new_term[starts], False)),
        pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(place), len(place)], pa.int32()), pa.array(place)),
        pa.ListArray.from_arrays(pa.array([*[0] * (n + 1), len(ids)], pa.int32()), ids)],
        names=["m", "part", "term", "tf", "top", "places", "ids"])


def _impact(tf, m):
    return F.call_function("div", F.lit(1_000_000_000) * tf, F.lit(1000) * tf + F.lit(8) * m)


def _visit(picked: DataFrame, asks: DataFrame, top: int, slices: int) -> DataFrame:
    """(item, part, place, score): the ``top`` best documents of each asked part whose score reaches the floor.

    ``asks`` has item, part, floor and ``asked``, the item's (term, weight) as an array.
    """
    def score(lists: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if lists.num_rows and asked.num_rows:
            lists = lists.sort_by("term")
            places = lists.column("places").combine_chunks()
            tf, sizes, m = lists.column("tf").to_numpy(), np.diff(places.offsets.to_numpy()), lists.column("m")[0].as_py()
            # Once per (m, tf), whatever the number of items and documents.
            impact = np.repeat((1_000_000_000 * tf) // (1000 * tf + 8 * m), sizes)
            at = places.flatten().to_numpy()
            coded = lists.column("term").combine_chunks().dictionary_encode()
            ends = np.cumsum(sizes)[np.flatnonzero(np.append(np.diff(coded.indices.to_numpy()) != 0, True))]
            begins = np.concatenate(([0], ends[:-1]))
            wanted = asked.column("asked").combine_chunks()
            codes = pc.fill_null(pc.index_in(wanted.flatten().field("term"), value_set=coded.dictionary), -1).to_numpy()
            weights, cuts = wanted.flatten().field("weight").to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(wanted).to_numpy())))
            width = int(at.max()) + 1
            for row, (item, floor) in enumerate(zip(asked.column("item").to_pylist(), asked.column("floor").to_pylist())):
                scores = np.zeros(width, np.int64)
                for k in range(cuts[row], cuts[row + 1]):
                    if (code := codes[k]) >= 0:
                        # A document is in one list of a term at most.
                        a, b = begins[code], ends[code]
                        scores[at[a:b]] += weights[k] * impact[a:b]
                good = np.flatnonzero(scores >= max(floor, 1))
                # Places are in order of ids, so ties go to the smallest.
                good = good[np.lexsort((good, -scores[good]))[:top]]
                if len(good):
                    found.append((item, good, scores[good]))
        part = asked.column("part")[0].as_py() if found else 0
        sizes = [len(g) for _, g, _ in found]
        return pa.table({"item": pa.array(np.repeat(np.array([i for i, _, _ in found], np.int64), sizes)), "part": pa.array(np.full(sum(sizes), part, np.int64)),
                         "place": pa.array(np.concatenate([g for _, g, _ in found] or [[]]).astype(np.int32)),
                         "score": pa.array(np.concatenate([x for _, _, x in found] or [[]]).astype(np.int64))})

    asks = asks.withColumn("slice", F.pmod("item", F.lit(slices).cast("long")))
    lists = picked.join(asks.select("part").distinct(), "part", "left_semi").select(
        "m", "part", "term", "tf", "places", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    return (lists.groupBy("part", "slice").cogroup(asks.select("part", "slice", "item", "floor", "asked").groupBy("part", "slice"))
            .applyInArrow(score, "item long, part long, place int, score long"))


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP, first_parts: int = FIRST_PARTS) -> DataFrame:
    """(key, rank, doc_id, score): the ``top`` documents of highest score above 0 for each item, ties by ascending id (null last).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact (10^9 tf) div (1000 tf + 8 m); an item's score sums
    weight times impact over its terms with repeats, in 64-bit integers. Items without a known term, null texts among them, have no
    row; wholly repeated items are answered once, items that share an id but not the text each on their own.
    """
    asked = _counted(items.select(named(key).alias("id"), named(text).alias("text")).distinct(), items.schema[key].dataType.simpleString())
    asked = stage(asked.withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    slices = max(1, math.ceil(asked.count() / SLICE_ITEMS))
    terms = asked.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    # The lists of the items' terms; everything after this reads them alone.
    picked = stage(index.postings.join(terms.select("term").distinct(), "term", "left_semi"), "lexical-picked")
    weights = picked.groupBy("term").agg(F.sum(F.size("places")).alias("df")).select(
        "term", F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))).alias("w"))
    weighted = stage(terms.join(weights, "term").select("item", "term", (F.col("times") * F.col("w")).alias("weight")).filter("weight > 0"), "lexical-weights")
    wanted = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("asked"))
    bounds = stage(picked.filter("top").select("m", "part", "term", _impact(F.col("tf"), F.col("m")).alias("most")).join(weighted, "term")
                   .groupBy("item", "part").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")), "lexical-bounds")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "part")
    first = stage(bounds.withColumn("visit", F.row_number().over(order)).filter(F.col("visit") <= first_parts).select("item", "part"), "lexical-first")
    found = stage(_visit(picked, first.withColumn("floor", F.lit(1).cast("long")).join(wanted, "item"), top, slices), "lexical-found")
    best = Window.partitionBy("item").orderBy(F.col("score").desc())
    floors = found.withColumn("place_", F.row_number().over(best)).filter(F.col("place_") == top).select("item", F.col("score").alias("floor"))
    rest = (bounds.join(first, ["item", "part"], "left_anti").join(floors, "item", "left")
            .withColumn("floor", F.coalesce("floor", F.lit(1).cast("long"))).filter(F.col("bound") >= F.col("floor")))
    every = found.unionByName(_visit(picked, rest.select("item", "part", "floor").join(wanted, "item"), top, slices))
    named_ = every.join(index.parts.select("part", "ids"), "part").select("item", "part", "place", "score", F.get("ids", F.col("place")).alias("doc_id"))
    ranked = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "part", "place")
    return (named_.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
            .join(asked.select("item", F.col("id").alias(key)), "item").select(key, "rank", "doc_id", "score"))
