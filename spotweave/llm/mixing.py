"""Mixing sources to target weights in words.

1. Every source gets a target: shares by weight, capped at a multiple of its size, the excess reshared.
2. Its documents are dealt by hash into blocks of similar size, and the blocks stand in an order that is the
   order of their hash: a random permutation of the source. The target takes whole passes over the blocks and
   then the first blocks of one more pass, the last of which is cut at the word where the target is reached.
3. The blocks of all sources are spread over output shards by a splitting tree: the root holds the exact block
   quota of every source; each node gives its left half a multivariate hypergeometric draw of its quotas and
   its right half the rest. A shard's draws from a source are then the next blocks in that source's order, so
   draws are disjoint. Within a shard rows are shuffled by a hash.

Each tree node draws from a generator seeded by its own place, so any task can walk to its own shards alone and a
rerun draws the same. Only per-source and per-block sums are shuffled before the last step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.common import WORD, keep_columns, named
from spotweave.session import stage

BLOCK_WORDS = 50_000
BLOCK_ROWS = 2_000
SHARD_BLOCKS = 8
MAX_SOURCES = 1_000_000  # one row each on the driver
BROADCAST_SOURCES = 100_000  # rows of about 100 bytes; more are joined by shuffling
SUPER = 4096  # blocks whose running sum one task takes


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what a cap cuts off is reshared by weight."""
    out, left = [0.0] * len(sizes), float(total)
    # The source that meets its cap first has the smallest cap per weight.
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i))
    weight = float(sum(weights))
    for i in order:
        out[i] = min(cap * sizes[i], left * weights[i] / weight if weight > 0 else 0.0)
        left, weight = left - out[i], weight - weights[i]
    return out


def _split(node: tuple[int, int], quota: np.ndarray, seed: int) -> np.ndarray:
    """How much of every source's quota goes to the left half of a node's shards; proportional to its shards."""
    low, high = node
    middle = (low + high) // 2
    rng = np.random.default_rng([seed, low, high])
    total = int(quota.sum())
    draws = total * (middle - low) // (high - low)
    out = np.zeros_like(quota)
    for i in np.flatnonzero(quota):
        good = int(quota[i])
        out[i] = rng.hypergeometric(good, total - good, draws) if draws and total > good else min(good, draws)
        total, draws = total - good, draws - int(out[i])
    return out


def shard_quotas(quota: np.ndarray, shards: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its quota of every source, what the shards before it have) for shards low <= shard < high."""
    pending = [((0, shards), quota, np.zeros_like(quota))]
    while pending:
        (a, b), own, before = pending.pop()
        if b <= low or a >= high:
            continue
        if b - a == 1:
            yield a, own, before
            continue
        left, middle = _split((a, b), own, seed), (a + b) // 2
        pending.append(((middle, b), own - left, before + left))
        pending.append(((a, middle), left, before))


def _source_table(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> list[dict]:
    """Size, target and number of blocks of every source; one small row per source reaches the driver."""
    rows = (sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
            .limit(MAX_SOURCES + 1).collect())
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # Code point order is the order of UTF-8 bytes; null comes last.
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    by = [weights[i % len(weights)] for i in range(len(rows))]
    words = [r["words"] for r in rows]
    goal = targets(words, by, share * sum(words), cap)
    return [{"number": i, "source": r["source"], "source_size": r["words"], "target": goal[i],
             "blocks": max(1, -(-r["words"] // BLOCK_WORDS), -(-r["rows"] // BLOCK_ROWS))} for i, r in enumerate(rows)]


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        text: str = "text", source: str = "source", key: str = "doc_id", words: str | None = None, seed: int = 11) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``draws``.

    Weights repeat over the sources in code point order, null being a source of its own and last. ``taken`` is the
    number of a document's words in the mix, repeats counted; ``draws`` lists its occurrences as (pass, shard, words). A
    source's taken words add up to its target rounded down; no document has more than ceil(cap) draws. Null and empty
    texts have size 0 and are drawn with their block. Repeated rows are documents of their own and get the same draws;
    where the target cuts them they share what is left in equal parts, rounded down. The draw depends on ids, texts and the
    seed only. ``words`` names a column that holds the sizes already; ``text`` may then be a digest of the text. Columns of
    the new names are replaced; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    # A digest of id and text stands for the row, so a repeated or null id cannot gather in one block.
    sized = docs.select(keep_columns(docs, "size", "source_size", "target", "taken", "draws").alias("_row"),
                        named(source).alias("source"), (named(words) if words else word_count(named(text))).alias("size"),
                        F.xxhash64(named(key), named(text), F.lit(seed)).alias("hash"))
    light = stage(sized.select("source", "size", "hash"), "mix-sizes")
    table = _source_table(light, weights, share, cap)
    sources = spark.createDataFrame(
        [(r["number"], r["source"], r["source_size"], r["target"], r["blocks"]) for r in table],
        "number int, source string, source_size long, target double, blocks long")

    def placed(df: DataFrame) -> DataFrame:
        # The number of sources is known here: a checked few are broadcast, so that texts are not dealt out by source.
        right = sources.withColumnRenamed("source", "_source")
        right = F.broadcast(right) if len(table) <= BROADCAST_SOURCES else right
        return (df.join(right, df["source"].eqNullSafe(right["_source"])).drop("_source")
                .withColumn("block", F.pmod("hash", "blocks")))

    # Where each block begins on its source's line of words, in block order.
    blocks = placed(light).groupBy("number", "source_size", "target", "block").agg(F.sum("size").alias("words"))
    blocks = stage(blocks.withColumn("part", F.floor(F.col("block") / SUPER)), "mix-blocks")
    parts = blocks.groupBy("number", "part").agg(F.sum("words").alias("part_words"), F.count("*").alias("part_blocks"))
    ahead = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("number", "part", F.coalesce(F.sum("part_words").over(ahead), F.lit(0)).alias("w0"),
                         F.coalesce(F.sum("part_blocks").over(ahead), F.lit(0)).alias("b0"))
    within = Window.partitionBy("number", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    goal, whole = F.floor("target").cast("long"), F.greatest(F.col("source_size"), F.lit(1))
    placed_blocks = stage(
        blocks.join(parts, ["number", "part"])
        .withColumn("begin", F.col("w0") + F.coalesce(F.sum("words").over(within), F.lit(0)))
        .withColumn("rank", F.col("b0") + F.count("*").over(within))
        .withColumn("passes", F.expr("floor(target) div greatest(source_size, 1)"))
        .withColumn("rest", goal - F.col("passes") * whole)
        # Words of this block that the last, partial pass takes.
        .withColumn("last", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("begin"))))
        .select("number", "block", "words", "rank", "passes", "last"), "mix-order")

    # Exact block quotas: whole passes over all blocks, and the blocks the last pass touches.
    quotas = {r["number"]: r for r in placed_blocks.groupBy("number").agg(
        F.count("*").alias("n"), F.max("passes").alias("passes"), F.sum((F.col("last") > 0).cast("long")).alias("more")).collect()}
    quota = np.array([quotas[r["number"]]["n"] * quotas[r["number"]]["passes"] + quotas[r["number"]]["more"] for r in table], np.int64)
    counts = {n: r["n"] for n, r in quotas.items()}
    shards = max(1, int(-(-quota.sum() // SHARD_BLOCKS))) if len(table) else 0

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            number, shard, rank, turn = [], [], [], []
            for leaf, own, before in shard_quotas(quota, shards, int(ids.min()), int(ids.max()) + 1, seed) if len(ids) else ():
                for i in np.flatnonzero(own).tolist():
                    at = np.arange(before[i], before[i] + own[i])
                    number += [i] * len(at)
                    shard += [leaf] * len(at)
                    rank += (at % counts[i]).tolist()
                    turn += (at // counts[i]).tolist()
            yield pa.RecordBatch.from_pydict({"number": pa.array(number, pa.int32()), "rank": pa.array(rank, pa.int64()),
                                              "pass": pa.array(turn, pa.int32()), "shard": pa.array(shard, pa.int64())})

    drawn = (spark.range(shards).mapInArrow(leaves, "number int, rank long, pass int, shard long")
             .groupBy("number", "rank").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("turns")))
    planned = stage(placed_blocks.join(drawn, ["number", "rank"], "left")
                    .select("number", "block", "passes", "words", "last", "turns"), "mix-plan")

    # Inside the one block per source that the target cuts, the words before each document.
    inner = Window.partitionBy("number", "block").orderBy("order", "hash").rowsBetween(Window.unboundedPreceding, -1)
    order = F.xxhash64("hash", F.lit(seed)).alias("order")
    cut_blocks = planned.filter((F.col("last") > 0) & (F.col("last") < F.col("words"))).select("number", "block", "last")
    # Written, so that its size is known: one block per source, nearly always small enough to be broadcast.
    cut = stage(placed(light).join(cut_blocks, ["number", "block"]).select("number", "block", "last", "size", "hash", order)
           .withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
           .groupBy("number", "block", "hash").agg(F.floor(F.avg(
               F.greatest(F.lit(0), F.least(F.col("size"), F.col("last") - F.col("before"))))).alias("part")), "mix-cut")

    full = placed(sized).join(planned, ["number", "block"]).join(cut, ["number", "block", "hash"], "left")
    draws = F.filter(F.transform("turns", lambda t: F.struct(
        t["pass"].alias("pass"), t["shard"].alias("shard"),
        F.when(t["pass"] < F.col("passes"), F.col("size"))
         .otherwise(F.coalesce("part", F.when(F.col("last") >= F.col("words"), F.col("size")).otherwise(F.lit(0)))).alias("words"))),
        lambda d: (d["words"] > 0) | (F.col("size") == 0))
    return (full.withColumn("draws", F.coalesce(draws, F.expr("cast(array() as array<struct<pass:int,shard:bigint,words:bigint>>)")))
            .select("_row.*", "size", "source_size", "target",
                    F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws"))


def occurrences(mixed: DataFrame, key: str = "doc_id", seed: int = 11) -> DataFrame:
    """One row per occurrence in the mix: the document's columns with ``pass``, ``shard``, ``words`` and ``place``.

    ``place`` is a hash: sorting a shard by it is the local shuffle, e.g. ``repartition("shard").sortWithinPartitions("shard",
    "place")`` before writing. ``words`` below the size means that the occurrence ends after so many words. Columns of the
    new names are replaced.
    """
    kept = [c for c in mixed.columns if c not in ("draws", "pass", "shard", "words", "place")]
    return (mixed.select(*map(named, kept), F.explode("draws").alias("_draw"))
            .select(*map(named, kept), "_draw.pass", "_draw.shard", "_draw.words",
                    F.xxhash64(named(key), "_draw.pass", "_draw.shard", F.lit(seed)).alias("place")))


def mixed_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, one per occurrence, shards together and shuffled inside.

    Texts stay to the letter. The one occurrence of each source that the target cuts is taken whole if at least half
    of its words are wanted, else left out, so a source is off its target by half a document at most. Options are those of :func:`mix`.
    """
    packed = docs.select(keep_columns(docs).alias("_doc"), named(text).alias("_text"), named(key).alias("_key"), named(source).alias("_source"))
    drawn = occurrences(mix(packed, text="_text", key="_key", source="_source", **options), "_key")
    placed = (drawn.filter(2 * F.col("words") >= F.col("size")).select("_doc", "shard", "place")
              .repartition("shard").sortWithinPartitions("shard", "place"))
    return placed.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
