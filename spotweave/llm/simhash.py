"""SimHash fingerprints of whole texts and near-duplicate classes found with BK-trees.

Fingerprints within three bits agree in one of four 16-bit bands. Each (band, value) is a shard: its
distinct fingerprints form a BK-tree whose children are keyed by Hamming distance to their parent, and
the shard's queries follow only the edges within the radius. Shards above ``SHARD_ROWS`` are dealt again by four
12-bit bands of the other 48 bits (three differing bits leave one of these alike too); what is still
larger is cut into tree chunks and query chunks, and each tree chunk is sent to every query chunk of
its shard, so no task ever holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import SLICE_BYTES, hash_sample, keep_columns, named, sliced
from spotweave.llm.components import components
from spotweave.session import stage

RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD_ROWS = 4096
SLICE = 1 << 16  # shingles hashed at once, bounds a worker's memory


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 for null or wordless text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begins), SLICE):
        spans = zip(begins[at:at + SLICE], ends[at:at + SLICE])
        hashes = np.array([digest(flat[a:b], seed) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(begins)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of the text; the text itself is dropped."""
    kept = [c for c in docs.columns if c not in (out, text)]
    plain = docs.select(*map(named, kept), named(text))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(len(kept))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*kept, out])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(work, f"{fields}`{out}` long")


class BKTree:
    """Children keyed by the Hamming distance to their parent, built and searched for many values at once."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        if len(values):
            self._grow(np.arange(len(values)))

    def _grow(self, members: np.ndarray) -> None:
        pending = [members]
        while pending:
            members = pending.pop()
            root, rest = members[0], members[1:]
            if not len(rest):
                continue
            distance = np.bitwise_count(self.values[rest] ^ self.values[root])
            order = np.argsort(distance, kind="stable")
            cuts = np.flatnonzero(np.diff(distance[order])) + 1
            for part in np.split(order, cuts):
                self.children[root][int(distance[part[0]])] = int(rest[part[0]])
                pending.append(rest[part])

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(tree node, queries within the radius of it); only edges that can hold a match are followed."""
        pending = [(0, np.arange(len(queries)))] if len(self.values) and len(queries) else []
        while pending:
            node, asked = pending.pop()
            distance = np.bitwise_count(queries[asked] ^ self.values[node]).astype(np.int16)
            near = distance <= radius
            if near.any():
                yield node, asked[near]
            for edge, child in self.children[node].items():
                on = np.abs(distance - edge) <= radius
                if on.any():
                    pending.append((child, asked[on]))


def _forest(tree: np.ndarray, queries: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between tree and query values that join all their pairs within the radius, without the redundant ones."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = up
        return x

    links = []
    for node, near in BKTree(tree).search(queries, radius):
        one = int(tree[node].view(np.int64))
        for other in queries[near].view(np.int64).tolist():
            if other != one and (a := root(one)) != (b := root(other)):
                parent[a] = b
                links.append((one, other))
    return links


def _bands(value: Column, bits: int, places: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(place).alias("band"), F.shiftrightunsigned(value, place).bitwiseAND((1 << bits) - 1).alias("part"))
                     for place in places])


def _shards(fps: DataFrame, shard_rows: int) -> DataFrame:
    """(fp, shard, chunk_a, chunk_b, side): who meets whom; a fingerprint of an undivided shard comes once, as both."""
    first = fps.select("fp", F.explode(_bands(F.col("fp"), 16, [0, 16, 32, 48])).alias("b")).select(
        "fp", "b.band", F.concat_ws(":", "b.band", "b.part").alias("shard"))
    sizes = first.groupBy("shard").agg(F.count("*").alias("size")).filter("size > 1")
    sized = first.join(sizes, "shard")
    # The other 48 bits, brought together in the low bits.
    low = F.when(F.col("band") == 0, F.lit(0)).otherwise(F.col("fp").bitwiseAND(F.expr("shiftleft(1L, band) - 1")))
    rest = low.bitwiseOR(F.when(F.col("band") == 48, F.lit(0)).otherwise(
        F.expr("shiftleft(shiftrightunsigned(fp, band + 16), band)")))
    fine = (sized.filter(F.col("size") > shard_rows).select("fp", "shard", F.explode(_bands(rest, 12, [0, 12, 24, 36])).alias("c"))
            .select("fp", F.concat_ws(":", "shard", "c.band", "c.part").alias("shard")))
    fine_sizes = fine.groupBy("shard").agg(F.count("*").alias("size")).filter("size > 1")
    every = sized.filter(F.col("size") <= shard_rows).select("fp", "shard", "size").unionByName(
        fine.join(fine_sizes, "shard").select("fp", "shard", "size"))
    chunks = F.ceil(F.col("size") / shard_rows).cast("int")
    return (every.withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("fp", "shard", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asked"),
                    (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("in_asked")))


def near_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v) links between distinct fingerprints that connect all pairs within the radius.

    ``fps`` has one row per distinct signed fingerprint, column fp. Pairs whose ends another link of the same
    task joins already are left out: the links give the same connected components as all pairs,
    and their number stays in proportion to the fingerprints.
    """
    if not 0 <= radius <= 3:
        raise ValueError("four bands find pairs within a radius of 3 only")
    dealt = _shards(fps, shard_rows).repartition("shard", "tree", "asked").sortWithinPartitions("shard", "tree", "asked", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            # The last shard may go on in the next batch.
            keys = [table.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "tree", "asked")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(change):
                yield links(table.slice(0, change[-1]), change[:-1])
                held = table.slice(change[-1]).to_batches()
        if held:
            yield links(pa.Table.from_batches(held), np.array([], np.int64))

    def links(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        fp = table.column("fp").to_numpy().view(np.uint64)
        in_tree, in_asked = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("in_tree", "in_asked"))
        found: list[tuple[int, int]] = []
        bounds = [0, *cuts.tolist(), len(fp)]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                found += _forest(fp[a:b][in_tree[a:b]], fp[a:b][in_asked[a:b]], radius)
        return pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    return dealt.mapInArrow(work, "u long, v long")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, low): the smallest id in the component of every fingerprint of ``prints`` (doc_id, fp)."""
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    found = components(near_links(nodes.select("fp"), radius), "simhash-links")
    rooted = (nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed), ``fingerprint`` (16 hex digits), ``component_id``.

    Documents whose fingerprints differ in ``radius`` bits at most are linked; ``component_id`` is the smallest
    id reachable. Null and wordless texts have fingerprint zero and are linked like any other. A null id never
    becomes a component's id unless the component has no other; repeated rows share theirs.
    Documents with equal fingerprints are one node, so copies cost nothing in the search.
    """
    prints = stage(with_fingerprint(docs.select(named(key).alias("doc_id"), named(text).alias("text"))), "simhash")
    return prints.join(_classes(prints, radius), "fp").select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WIDTH = 5  # words of the shingles whose sets are compared
SIMILARITY = 0.8
REACH = 14  # differing bits up to which a pair is compared
TABLE_BITS = 14  # bits of a table's shards in a corpus of up to 2 ** 18 distinct texts, one more for each doubling
TABLES = 8  # tables searched then; what they join costs the search by prefixes nothing
GROWTH = 1.18  # as many times the tables for each further bit: near copies agree on a bit 0.85 times or more
BROADCAST_ROWS = 500_000  # rows of 24 bytes: texts to compare that are looked up by broadcast, more by a shuffle
SETS = "node long, size long, parts array<int>, shingles array<long>"
PARTS = 128  # parts of a shingle set, by its hashes, whose sizes bound what two sets share; a power of two
SMALL = 64  # members of a shard up to which all shards of a batch are worked on at once, by the same rule
COMMON_SAMPLE = 20_000  # texts in which common shingles are looked for; whichever are found, no pair is missed
COMMON = 1 << 17  # common shingles known at most, 16 bytes each
AT_ONCE = 100  # pairs of holders of shingles, a text, up to which all are compared at once
NEXT = 2  # holders of a shingle after each that are compared before all the others
CROWD = 256  # holders of a shingle up to which all shingles of a batch are worked on at once
CELLS = 1 << 20  # pairs of holders of one shingle looked at at once


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    width = min(width, len(words))
    found = (xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), SEED) for i in range(len(words) - width + 1))
    return np.unique(np.fromiter(found, np.uint64, len(words) - width + 1)).view(np.int64)


def _places(tables: int, bits: int) -> np.ndarray:
    """Bit positions of each table, drawn once and for all."""
    rng = np.random.default_rng(SEED)
    return np.array([rng.permutation(64)[:bits] for _ in range(tables)])


def _dealt(nodes: DataFrame, first: int, last: int, shard_rows: int, width: int = TABLE_BITS) -> DataFrame:
    """(shard, fine, tree, asked, in_tree, in_asked, node, fp, root): a node once per table, by the ``width`` bits the table looks at.

    Members of a crowded shard go to finer ones by further bits of their own table, and chunks of what is still crowded all meet.
    Where no shard is crowded, the columns that say so are left out: they would double the rows that are shuffled and sorted.
    """
    places = _places(last, 2 * width)[first:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((64, 2 * len(places)))
        for t, own in enumerate(places):
            weights[own[:width], t] = weights[own[width:], len(places) + t] = 1 << np.arange(width)
        # A row of 24 bytes becomes one of 40 for each table.
        for batch in sliced(batches, SLICE_BYTES // (2 * len(places))):
            fp = batch.column("fp").to_numpy()
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            keys = (bits @ weights).astype(np.int64)
            shard, fine = keys[:, :len(places)] + ((first + np.arange(len(places))) << 32), keys[:, len(places):]
            copies = pa.array(np.repeat(np.arange(len(fp)), len(places)))
            yield pa.RecordBatch.from_arrays([pa.array(shard.ravel()), pa.array(fine.ravel()), *[batch.column(c).take(copies) for c in ("node", "fp", "root")]],
                                             names=["shard", "fine", "node", "fp", "root"])

    rows = nodes.select("node", "fp", "root").mapInArrow(work, "shard long, fine long, node long, fp long, root long")
    crowded = stage(rows.groupBy("shard").agg(F.count("*").alias("size")).filter(F.col("size") > shard_rows), "copies-crowded")
    if crowded.isEmpty():
        return rows.select("shard", "node", "fp", "root")
    # Half of the further bits: members that differ in a few bits still meet in one table or another.
    finer = F.when(F.col("size").isNotNull(), F.col("fine").bitwiseAND((1 << (width // 2)) - 1) + 1).otherwise(0)
    marked = rows.join(crowded, "shard", "left").withColumn("fine", finer.cast("long")).drop("size")
    still = (marked.filter("fine > 0").groupBy("shard", "fine").agg(F.count("*").alias("size"))
             .select("shard", "fine", F.ceil(F.col("size") / shard_rows).cast("int").alias("chunks")))
    cut = (marked.join(still, ["shard", "fine"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
           .withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))))
    return cut.select("shard", "fine", F.least("own", "other").alias("tree"), F.greatest("own", "other").alias("asked"),
                      (F.col("own") <= F.col("other")).alias("in_tree"), (F.col("own") >= F.col("other")).alias("in_asked"), "node", "fp", "root")


def _near_places(fp: np.ndarray, root: np.ndarray, in_tree: np.ndarray, in_asked: np.ndarray, radius: int, spare: int) -> Iterator[tuple[int, int]]:
    """Pairs of places of a shard within the radius whose roots differ, but for those that earlier ones make redundant.

    Each member is looked at with the k-th after it, for k = 1, 2, ... A pair is redundant if earlier ones join its roots and both
    its members are in ``spare`` pairs already. What is redundant when a k begins stays so, hence is left out at once.
    """
    names, joined = np.unique(root, return_inverse=True)
    own, times = joined, np.zeros(len(fp), np.int64)
    joined = joined.copy()
    for k in range(1, len(fp)):
        first = np.flatnonzero((np.bitwise_count(fp[:-k] ^ fp[k:]) <= radius) & (own[:-k] != own[k:])
                               & ((in_tree[:-k] & in_asked[k:]) | (in_asked[:-k] & in_tree[k:]))
                               & ((joined[:-k] != joined[k:]) | (np.minimum(times[:-k], times[k:]) < spare)))
        for x in first.tolist():
            y = x + k
            if joined[x] != joined[y]:
                joined[joined == joined[y]] = joined[x]
            elif min(times[x], times[y]) >= spare:
                continue
            times[x] += 1
            times[y] += 1
            yield x, y


def _close_pairs(dealt: DataFrame, radius: int, turn: int, spare: int) -> DataFrame:
    """(u, v), u < v: pairs of nodes within the radius that join different roots, without those that others of the same shard make redundant.

    A node comes in ``spare`` pairs nevertheless, as some may turn out not to be alike. One rule holds for shards of every size.
    """
    key, sides = ([c for c in names if c in dealt.columns] for names in (("shard", "fine", "tree", "asked"), ("in_tree", "in_asked")))
    # Another order each turn: a pair that turned out not to be alike hides others that it made look redundant.
    placed = dealt.repartition(*key).sortWithinPartitions(*key, F.xxhash64("fp", F.lit(turn)), "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in key]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(change):
                yield links(table.slice(0, change[-1]), change[:-1])
                held = table.slice(change[-1]).to_batches()
        if held:
            yield links(pa.Table.from_batches(held), np.array([], np.int64))

    def links(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        fp, node, root = (table.column(c).to_numpy() for c in ("fp", "node", "root"))
        fp, root = fp.view(np.uint64), root.copy()
        in_tree, in_asked = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in sides) if sides else np.ones((2, len(fp)), bool)
        bounds = np.concatenate(([0], cuts, [len(fp)]))
        sizes = np.diff(bounds)
        shard = np.repeat(np.arange(len(sizes)), sizes)
        pairs: list[tuple[int, int]] = []
        # Small shards, which most are, all at once by the rule of _near_places; there is no tree or chunk to tell apart in them.
        after = bounds[1:][shard] - np.arange(len(fp)) - 1
        chunked = np.add.reduceat(~(in_tree & in_asked), bounds[:-1]) > 0 if len(fp) else np.zeros(0, bool)
        together = (sizes <= SMALL) & ~chunked
        left_over = np.flatnonzero(together[shard])
        parent: dict[tuple[int, int], int] = {}
        times: dict[int, int] = {}
        for k in range(1, SMALL):
            left_over = left_over[after[left_over] >= k]
            if not len(left_over):
                break
            near = left_over[(np.bitwise_count(fp[left_over] ^ fp[left_over + k]) <= radius) & (root[left_over] != root[left_over + k])]
            for x, y in zip(near.tolist(), (near + k).tolist()):
                s = int(shard[x])
                left, right = (s, int(root[x])), (s, int(root[y]))
                while (up := parent.get(left, left[1])) != left[1]:
                    left = (s, up)
                while (up := parent.get(right, right[1])) != right[1]:
                    right = (s, up)
                if left != right:
                    parent[right] = left[1]
                elif min(times.get(x, 0), times.get(y, 0)) >= spare:
                    continue
                times[x], times[y] = times.get(x, 0) + 1, times.get(y, 0) + 1
                pairs.append((x, y))
        for n in np.flatnonzero(~together):
            at, to = int(bounds[n]), int(bounds[n + 1])
            pairs += [(at + x, at + y) for x, y in _near_places(fp[at:to], root[at:to], in_tree[at:to], in_asked[at:to], radius, spare)]
        x, y = (np.array(side, np.int64) for side in (zip(*pairs) if pairs else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["u", "v"])

    return placed.select(*key, *sides, "node", "fp", "root").mapInArrow(work, "u long, v long").distinct()


def _least(size: np.ndarray | int, similarity: float) -> np.ndarray | int:
    """Elements that a set shares with any set it is alike, in whole numbers."""
    return -(-round(similarity * 1000) * size // 1000)


def _common(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample of the texts, in order, and how many of them hold each."""
    sample = hash_sample(docs.select(named(text).alias("text")), COMMON_SAMPLE, "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["shingle"])

    found = (sample.mapInArrow(work, "shingle long").groupBy("shingle").agg(F.count("*").alias("holders")).filter("holders > 1")
             .orderBy(F.desc("holders"), "shingle").limit(COMMON).toArrow().sort_by("shingle"))
    return found.column("shingle").to_numpy(), found.column("holders").to_numpy()


def _prefixes(docs: DataFrame, text: str, similarity: float, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(words_a, words_b, size, prefix): of every distinct word sequence the size of its shingle set and the shingles it is looked up by.

    A set of n shingles shares at least m = ceil(similarity * n) with any set it is alike. So the first n - m + 1 shingles of both, in an
    order that is one for all texts, have one in common, and it stands where enough may still follow. Common shingles come last in that order, by
    how common they are, the others by their hashes: what few texts hold is what most are looked up by.
    """
    known, holders = common

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, sizes, firsts = [], [], []
            for value in batch.column("text"):
                body = value.as_py()
                words = _words(body)
                own = shingle_set(body, width)
                first = len(own) - _least(len(own), similarity) + 1 if len(own) else 0
                if len(known) and len(own):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, holders[at], 0), kind="stable")]
                keys.append((xxhash.xxh64_intdigest(words, SEED), xxhash.xxh64_intdigest(words, SEED + 1)))
                sizes.append(len(own))
                firsts.append(own[:first])
            keys = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in keys.T], pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))],
                                             names=["words_a", "words_b", "size", "prefix"])

    found = docs.select(named(text).alias("text")).mapInArrow(work, "words_a long, words_b long, size int, prefix array<long>")
    return found.dropDuplicates(["words_a", "words_b"])


def _by_shingle(holders: DataFrame, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of the holders of shingles (shingle, node, size, place, root), all of a shingle together in order of size; it gets a table and where shingles begin."""
    dealt = holders.select("shingle", "node", "size", "place", "root").repartition("shingle").sortWithinPartitions("shingle", "size", "node")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last shingle may go on in the next batch.
            held.append(batch)
            if held[0].column("shingle")[0] == batch.column("shingle")[-1]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            shingle = table.column("shingle").to_numpy()
            begins = np.concatenate(([0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1))
            if begins[-1]:
                yield from work(table.slice(0, begins[-1]), begins[:-1])
            held = table.slice(begins[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, np.zeros(1, np.int64))  # one shingle alone

    return dealt.mapInArrow(task, schema)


def _shared(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Holders of the shingles whose holders are not all joined."""
    root = table.column("root").to_numpy()
    sizes = np.diff(np.concatenate((begins, [len(root)])))
    several = np.minimum.reduceat(root, begins) != np.maximum.reduceat(root, begins)
    yield from table.select(["shingle", "node", "size", "place"]).filter(pa.array(np.repeat(several, sizes))).combine_chunks().to_batches()


def _sharing(similarity: float, most: int | None) -> Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]:
    """Pairs (u, v), u < v, of holders of a shingle that are not joined and may be alike: all, or each with the ``most`` after it only."""
    share = round(similarity * 1000)

    def work(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size, place, root = (table.column(c).to_numpy() for c in ("node", "size", "place", "root"))
        size, place = size.astype(np.int64), place.astype(np.int64)
        after = size - place  # of a set from this shingle on
        bounds = np.concatenate((begins, [len(node)]))
        end = np.repeat(bounds[1:], np.diff(bounds))
        # Holders are in order of size: those beyond are too large to be alike.
        last = np.minimum(end, np.arange(len(node)) + 1 + most) if most else end

        def pairs(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            # The first shingle that two sets share has all that they share after it.
            held = np.minimum(after[x], after[y])
            near = (root[x] != root[y]) & (1000 * size[x] >= share * size[y]) & (1000 * held >= share * (size[x] + size[y] - held))
            if near.any():
                u, v = node[x[near]], node[y[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        few = np.diff(bounds) <= CROWD
        left_over = np.flatnonzero(np.repeat(few, np.diff(bounds)) if not most else np.ones(len(node), bool))
        k = 1
        while len(left_over := left_over[left_over + k < last[left_over]]):
            left_over = left_over[1000 * size[left_over] >= share * size[left_over + k]]
            yield from pairs(left_over, left_over + k)
            k += 1
        for n in np.flatnonzero(~few) if not most else ():
            at, to = int(bounds[n]), int(bounds[n + 1])
            names, own = np.unique(root[at:to], return_inverse=True)
            # The most joined ones, not to be held against each other, are many; every other meets all.
            crowd = own == np.bincount(own, minlength=len(names)).argmax()
            others = at + np.flatnonzero(~crowd)
            step = max(1, CELLS // (to - at))
            for some in range(0, len(others), step):
                x = np.repeat(others[some:some + step], to - at)
                y = np.tile(np.arange(at, to), len(x) // (to - at))
                once = crowd[y - at] | (x < y)
                yield from pairs(np.minimum(x, y)[once], np.maximum(x, y)[once])

    return work


def _words(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


def _words_key(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, digest_a, digest_b, words_a, words_b, fp): hashes of the row, 128 bits of the word sequence, the fingerprint."""
    row = F.struct(*map(named, docs.columns))
    plain = docs.select(named(key).alias("doc_id"), F.xxhash64(row).alias("digest_a"), F.xxhash64(F.lit(1), row).alias("digest_b"), named(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column("text"):
                body = value.as_py()
                words = _words(body)
                found.append((xxhash.xxh64_intdigest(words, SEED), xxhash.xxh64_intdigest(words, SEED + 1), fingerprint(body)))
            prints = np.array(found, np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(c)) for c in prints.T]],
                                             names=["doc_id", "digest_a", "digest_b", "words_a", "words_b", "fp"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(work, f"doc_id {kind}, digest_a long, digest_b long, words_a long, words_b long, fp long")


def _of_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``sets`` that pairs name, so that no others are shuffled."""
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    return sets.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "node", "left_semi")


def _likely(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sets may have at least this Jaccard similarity, by their sizes and the sizes of their parts.

    Two sets share no more elements of a part than the smaller part has, so no pair that is alike is left out.
    """
    share = round(similarity * 1000)
    joined, held = pairs, _of_pairs(sets.select("node", "size", "parts"), pairs)
    for side in ("u", "v"):
        joined = joined.join(held.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("parts").alias(f"parts_{side}")), side)
    most = F.aggregate(F.zip_with("parts_u", "parts_v", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda total, x: total + x)
    return (joined.filter(1000 * F.least("size_u", "size_v") >= share * F.greatest("size_u", "size_v"))
            .filter(1000 * most >= share * (F.col("size_u") + F.col("size_v") - most)).select("u", "v"))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose shingle sets have at least this Jaccard similarity, exactly; only the sets of likely pairs are moved."""
    likely = stage(_likely(pairs, sets, similarity), "copies-likely")
    joined, held = likely, _of_pairs(sets.select("node", "size", "shingles"), likely)
    for side in ("u", "v"):
        joined = joined.join(held.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_u", "set_v")).cast("long")
    # In whole numbers: a similarity of 0.8 is reached or not whatever a division rounds to.
    share = round(similarity * 1000)
    return joined.filter(1000 * both >= share * (F.col("size_u") + F.col("size_v") - both)).select("u", "v")


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH,
                reach: int = REACH, tables: int = TABLES, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): words_a, words_b and ``root`` of every distinct word sequence; prints name the sequence of every row.

    Texts are linked if the sets of their ``width``-word shingles (A-Z in lower case, white space between words) have at least this Jaccard
    similarity; every link is confirmed on the sets. The first candidates are pairs of fingerprints of 3-word shingles, of which near copies
    share more, within ``reach`` bits that agree on the bits of one of the tables; they join most of a crowd cheaply. Then come all pairs
    that share a shingle of their prefixes (see :func:`_prefixes`) and are not joined yet, as every pair that is alike does: no link is missed
    and none is made up.
    """
    prints = stage(_words_key(docs, key, text), "copies-prints")
    # Numbered in the order of their digests, so that reruns choose the same pairs.
    nodes = stage(prints.groupBy("words_a", "words_b").agg(F.min("fp").alias("fp")).repartitionByRange("words_a", "words_b")
                  .sortWithinPartitions("words_a", "words_b").withColumn("node", F.monotonically_increasing_id()), "copies-nodes")
    spark = docs.sparkSession
    links = tested = spark.createDataFrame([], "u long, v long")
    sets = spark.createDataFrame([], SETS)
    rooted = nodes.select("node", "fp", F.col("node").alias("root"))

    def compare(found: DataFrame) -> None:
        nonlocal links, tested, sets, rooted
        pairs = stage(found.join(tested, ["u", "v"], "left_anti"), "copies-pairs")
        if not (wanted := stage(_wanted(prints, nodes, pairs, sets), "copies-wanted")).isEmpty():
            # Each search's sets are a table of their own: those of earlier ones are not written again.
            sets = sets.unionByName(stage(_sets(docs, wanted, text, width), "copies-sets"))
        confirmed = stage(_confirmed(pairs, sets, similarity), "copies-links")
        tested = tested.unionByName(pairs)
        if not confirmed.isEmpty():
            links = stage(links.unionByName(confirmed), "copies-links")
            joined = components(links, "copies-roots")
            rooted = stage(nodes.join(joined, "node", "left").select("node", "fp", F.coalesce("root", "node").alias("root")), "copies-rooted")

    # Shards stay as full as they are: more texts, more bits, and as many more tables as the bits need.
    bits = min(28, max(TABLE_BITS, (nodes.count() - 1).bit_length() - 4))
    compare(_close_pairs(_dealt(rooted, 0, round(tables * GROWTH ** (bits - TABLE_BITS)), shard_rows, bits), reach, 0, 0))
    # Prefixes are moved once: what joins them is brought together first.
    named_roots = nodes.select("words_a", "words_b", "node").join(rooted.select("node", "root"), "node")
    held = _prefixes(docs, text, similarity, width, _common(docs, text, width)).join(named_roots, ["words_a", "words_b"])
    held = held.select("node", "size", "root", F.posexplode("prefix").alias("place", "shingle"))
    # Where all holders of a shingle are joined already there is nothing to look for; most shingles have one holder.
    shared = stage(_by_shingle(held, _shared, "shingle long, node long, size int, place int"), "copies-shared")
    # All at once, unless there may be so many that those after each should be joined first.
    crowds = shared.groupBy("shingle").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).first()["pairs"] or 0
    for most in (NEXT, None) if crowds > AT_ONCE * nodes.count() else (None,):
        compare(_by_shingle(shared.join(rooted.select("node", "root"), "node"), _sharing(similarity, most), "u long, v long").distinct())
    return prints, nodes.join(rooted.select("node", "root"), "node").select("words_a", "words_b", "root")


def _wanted(prints: DataFrame, nodes: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, digest_a, digest_b, copies): one row of each node that pairs name and ``known`` lacks, and how often it is repeated."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(known.select("node"), "node", "left_anti")
    return (nodes.join(wanted, "node").join(prints, ["words_a", "words_b"])
            .groupBy("node", "digest_a", "digest_b").agg(F.count("*").alias("copies"))
            .groupBy("node").agg(F.min(F.struct("digest_a", "digest_b", "copies")).alias("row")).select("node", "row.*"))


def _sets(docs: DataFrame, wanted: DataFrame, text: str, width: int) -> DataFrame:
    """The shingle sets of the wanted nodes: ``size``, sizes of their ``PARTS`` parts, ``shingles``. No set is shuffled."""
    row = F.struct(*map(named, docs.columns))
    hashed = docs.select(F.xxhash64(row).alias("digest_a"), F.xxhash64(F.lit(1), row).alias("digest_b"), named(text).alias("text"))

    def bodies(one: DataFrame) -> DataFrame:
        # By a broadcast the other texts need not be shuffled to be left out.
        return hashed.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, ["digest_a", "digest_b"]).select("node", "text")

    found, repeated = bodies(wanted.filter("copies = 1")), wanted.filter("copies > 1")
    if not repeated.isEmpty():
        # Wholly repeated rows have one digest and are one.
        found = found.unionByName(bodies(repeated).dropDuplicates(["node"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column("text")]
            parts = [np.bincount(s & (PARTS - 1), minlength=PARTS) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(parts, pa.list_(pa.int32())),
                                              pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "parts", "shingles"])

    return found.mapInArrow(work, SETS)


def keep_distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` with one document of each class of near copies, the one with the smallest id (see :func:`near_copies`).

    Null ids come last; among rows of one id the one with the smallest digest of all its columns stays, and of
    wholly repeated rows one. Null and wordless texts are copies of each other. An empty table stays empty.
    """
    prints, classes = near_copies(docs, key, text, similarity, width)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest_a", "digest_b")
    first = prints.join(classes, ["words_a", "words_b"]).groupBy("root").agg(F.min(order).alias("first")).select("first.digest_a", "first.digest_b")
    row = F.struct(*map(named, docs.columns))
    return (docs.select(F.xxhash64(row).alias("digest_a"), F.xxhash64(F.lit(1), row).alias("digest_b"), keep_columns(docs).alias("_row"))
            .join(first, ["digest_a", "digest_b"], "left_semi").dropDuplicates(["digest_a", "digest_b"]).select("_row.*"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate class, the one with the smallest id.

    Null ids come last; among rows of one id the one with the smallest digest of all its columns stays, and of
    wholly repeated rows one. An empty table stays empty.
    """
    digest = F.xxhash64(F.struct(*map(named, docs.columns)))
    prints = stage(with_fingerprint(docs.select(named(key).alias("doc_id"), digest.alias("digest"), named(text).alias("text"))), "simhash")
    by_class = prints.join(_classes(prints, radius).select("fp", "root"), "fp")
    first = by_class.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"))
    row = docs.select(digest.alias("_digest"), keep_columns(docs).alias("_row"))
    return (row.join(first.select(F.col("first.digest").alias("_digest")), "_digest", "left_semi")
            .dropDuplicates(["_digest"]).select("_row.*"))
