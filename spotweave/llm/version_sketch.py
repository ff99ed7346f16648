"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's fingerprint is a small sketch: every paragraph digest goes to one cell in each of three rows of cells, and a
cell holds the number, the xor of the digests and the xor of their checks. Sketches of two versions subtract cell by cell, so
paragraphs they share vanish; a cell that holds a single digest reveals it, it is taken out of its other
cells, and so on. Where cells are left over at the end, the sketch was too small and a larger one is tried.

A comparison sizes its first sketch by an estimate from the smallest digests of both versions and grows
fourfold on failure; after ``ATTEMPTS`` the digests themselves are compared.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotweave.llm.common import named
from spotweave.operators.ordered import with_previous
from spotweave.session import stage

ROWS = 3
FINGERPRINT_CELLS = 12  # of the fingerprint string, a multiple of ROWS
ESTIMATE = 16  # smallest digests that estimate a difference
STEPS = 12  # the three rows of cells are peeled one after the other, four times each
ATTEMPTS = 3
PIECE = 160
CHUNK_ROWS = 2_000
SHARES = 1 << 20  # parts that a crowded id can have


def paragraph_digests(text: Column) -> Column:
    """Sorted distinct 64-bit digests of a text's paragraphs; none for null, empty and blank texts.

    Paragraphs are lines and, within them, sentences; stretches of more than ``PIECE`` characters without a mark are
    divided, so that a version differs only near its edits.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n.!?]{{1,{PIECE}}}"), F.lit(0))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p)))),
                      F.expr("cast(array() as array<bigint>)"))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(101))


def _cell(digest: Column, row: int, cells_per_row: Column, attempt: Column | int) -> Column:
    seed = attempt if isinstance(attempt, Column) else F.lit(attempt)
    return F.pmod(F.xxhash64(digest, F.lit(row), seed), cells_per_row) + cells_per_row * row


def fingerprint(placed: Column) -> Column:
    """The sketch of ``FINGERPRINT_CELLS`` cells as hexadecimal text, cell by cell: number, digests, checks.

    ``placed`` comes from :func:`placed_digests` and should be a column of its own, it is read cell by cell.
    """
    def cell(j: int) -> Column:
        mine = F.filter(placed, lambda x: x[f"r{j // (FINGERPRINT_CELLS // ROWS)}"] == j)
        state = F.aggregate(mine, F.struct(*[F.lit(0).cast("long").alias(c) for c in "ndc"]), lambda a, x: F.struct(
            (a["n"] + 1).alias("n"), a["d"].bitwiseXOR(x["d"]).alias("d"), a["c"].bitwiseXOR(x["c"]).alias("c")),
            lambda a: F.concat(F.lpad(F.hex(a["n"]), 4, "0"), F.lpad(F.hex(a["d"]), 16, "0"), F.lpad(F.hex(a["c"].bitwiseAND(0xFFFFFFFF)), 8, "0")))
        return state

    return F.lower(F.concat(*[cell(j) for j in range(FINGERPRINT_CELLS)]))


def placed_digests(digests: Column) -> Column:
    """Digests with their checks and their cells in the fingerprint."""
    per_row = F.lit(FINGERPRINT_CELLS // ROWS).cast("long")
    return F.transform(digests, lambda d: F.struct(d.alias("d"), _check(d).alias("c"), *[_cell(d, r, per_row, 0).alias(f"r{r}") for r in range(ROWS)]))


def estimated_difference(a: Column, b: Column) -> Column:
    """Size of the symmetric difference, estimated from the smallest digests of both sets."""
    low = F.slice(F.array_sort(F.array_union(F.slice(a, 1, ESTIMATE), F.slice(b, 1, ESTIMATE))), 1, ESTIMATE)
    shared = F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.greatest(F.size(low), F.lit(1))
    return (F.size(a) + F.size(b)) * (1 - shared) / (1 + shared)


def _peel(items: DataFrame, keys: list[str], attempt: int) -> DataFrame:
    """keys, ``apart`` (differing digests recovered), ``left`` (cells that still hold something); no row where nothing differs.

    ``items`` has the keys, ``per_row`` (cells in a row), ``digest`` and ``side`` (1 or -1; a row of side 0 takes no part and comes out
    with its keys). Everything is grouped by the keys first, so rows that are dealt out by one of the keys already are
    not shuffled again.
    """
    placed = F.array(*[_cell(F.col("digest"), r, F.col("per_row"), attempt) for r in range(ROWS)])
    cells = (items.select(*keys, "per_row", "side", "digest", _check(F.col("digest")).alias("chk"),
                          F.explode(F.when(F.col("side") == 0, F.array(F.lit(-2).cast("long"))).otherwise(placed)).alias("cell"))
             .groupBy(*keys, "per_row", "cell").agg(F.sum("side").alias("n"), F.bit_xor("digest").alias("d"), F.bit_xor("chk").alias("chk"),
                                                     F.lit(0).cast("long").alias("got")))
    for step in range(STEPS):
        row = step % ROWS
        # One row of cells at a time: a digest has one cell in it, so it is taken out once.
        pure = ((F.col("cell") >= F.col("per_row") * row) & (F.col("cell") < F.col("per_row") * (row + 1))
                & (F.abs("n") == 1) & (F.col("chk") == _check(F.col("d"))))
        update = lambda cell, n, d, chk, got: F.struct(cell.alias("cell"), n.alias("n"), d.alias("d"), chk.alias("chk"), got.alias("got"))
        none = F.lit(0).cast("long")
        stay = update(F.col("cell"), F.col("n"), F.col("d"), F.col("chk"), F.col("got"))
        out = [update(_cell(F.col("d"), r, F.col("per_row"), attempt), -F.col("n"), F.col("d"), F.col("chk"), none) for r in range(ROWS)]
        count = update(F.lit(-1).cast("long"), none, none, none, F.lit(1).cast("long"))
        cells = (cells.select(*keys, "per_row", F.explode(F.when(pure, F.array(stay, *out, count)).otherwise(F.array(stay))).alias("u"))
                 .select(*keys, "per_row", "u.*")
                 .groupBy(*keys, "per_row", "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("chk").alias("chk"), F.sum("got").alias("got"))
                 .filter((F.col("cell") < 0) | (F.col("n") != 0) | (F.col("d") != 0) | (F.col("chk") != 0)))
    held = (F.col("n") != 0) | (F.col("d") != 0) | (F.col("chk") != 0)
    return cells.groupBy(*keys).agg(F.sum("got").alias("apart"), F.sum(held.cast("long")).alias("left"))


def _cells_per_row(a: Column, b: Column, growth: int) -> Column:
    return F.ceil((estimated_difference(a, b) * 2 + 18) * growth / ROWS).cast("long")


def _sided(digests: Column, side: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("digest"), F.lit(side).alias("side")))


def _items(pairs: DataFrame, keys: list[str], growth: int) -> DataFrame:
    """The digests of both versions with their side, and the cells in a row of the pair's sketch."""
    return (pairs.withColumn("per_row", _cells_per_row(F.col("a"), F.col("b"), growth))
            .select(*keys, "per_row", F.explode(F.concat(_sided(F.col("a"), 1), _sided(F.col("b"), -1))).alias("x"))
            .select(*keys, "per_row", "x.digest", "x.side"))


def differences(pairs: DataFrame, keys: list[str], first_attempt: int = 1) -> DataFrame:
    """keys and ``apart``, the size of the symmetric difference of the digest arrays ``a`` and ``b``.

    Sketches that do not peel to the end are tried again four times larger and with other cells; what is left after ``ATTEMPTS``
    is compared digest by digest. Keys must be unique and not null.
    """
    done, open_ = None, pairs
    for attempt in range(first_attempt, ATTEMPTS):
        peeled = _peel(_items(open_, keys, 4 ** attempt), keys, attempt)
        tried = stage(open_.select(*keys, "a", "b").join(peeled, keys, "left"), "sketch")
        solved = tried.filter(F.coalesce("left", F.lit(0)) == 0).select(*keys, F.coalesce("apart", F.lit(0)).cast("long").alias("apart"))
        done = solved if done is None else done.unionByName(solved)
        open_ = tried.filter(F.col("left") > 0).select(*keys, "a", "b")
    exact = open_.select(*keys, (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).cast("long").alias("apart"))
    return exact if done is None else done.unionByName(exact)


def likeness(size_a: Column, size_b: Column, apart: Column) -> Column:
    """Shared paragraphs over all paragraphs of two versions; 1 where both have none."""
    together = size_a + size_b
    return F.when(together == 0, F.lit(1.0)).otherwise((together - apart) / (together + apart))


def _chunks(docs: DataFrame, rows: int) -> tuple[Column, DataFrame | None, int]:
    """A chunk number that grows with doc_id and leaves about ``rows`` rows in a chunk; the chunks that stay crowded; the number of chunks.

    Crowded ones hold a single id, or the rows without one; their ``shares`` says how many parts they need.
    """
    found = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low = found["low"] or 0
    width = max(1, (found["high"] - low + 1) * rows // found["n"]) if found["n"] else 1
    while True:
        chunk = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.floor((F.col("doc_id") - low) / width)).cast("long")
        sizes = docs.groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"))
        top = sizes.agg(F.max(F.when(F.col("chunk") >= 0, F.col("n"))).alias("most"), F.count("*").alias("chunks"), F.max("n").alias("any"),
                        F.sum(F.when(F.col("n") > 4 * rows, F.floor(F.col("n") / rows))).alias("shares")).first()
        if (top["most"] or 0) <= 4 * rows or width == 1:
            crowded = sizes.filter(F.col("n") > 4 * rows).select("chunk", F.least(F.ceil(F.col("n") / rows), F.lit(SHARES)).alias("shares"))
            return chunk, crowded if (top["any"] or 0) > 4 * rows else None, (top["chunks"] or 0) + (top["shares"] or 0)
        # Ids lie close together somewhere: narrower chunks, of which only those in use count.
        width = max(1, width // 16)


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = CHUNK_ROWS) -> DataFrame:
    """chunk, rid, doc_id, text, next_text: every document with the text of the one that follows by descending id.

    After the last comes the first; null ids follow the others, ties are ordered by a digest of the text. Texts are shuffled
    once, by chunks of neighbouring ids; the first document of every chunk is put at the end of the chunk before it. Rows that share an id,
    or have none, are divided by ranges of their digests; only rows that share the text as well stay together.
    """
    base = docs.select(named(key).cast("long").alias("doc_id"), F.coalesce(named(text), F.lit("")).alias("text"))
    chunk, crowded, n_chunks = _chunks(base.select("doc_id"), rows)
    base = base.select((chunk * SHARES).alias("chunk"), "doc_id", "text", F.xxhash64("text").alias("digest"))
    if crowded is not None:
        # Rows of one id are in order of their digests, which are even, so ranges of digests are its parts.
        parts = stage(crowded.select((F.col("chunk") * SHARES).alias("chunk"), "shares"), "crowded")
        part = F.floor((F.col("digest") / 2.0 ** 64 + 0.5) * F.col("shares")).cast("long")
        base = base.join(parts, "chunk", "left").withColumn("chunk", F.col("chunk") + F.coalesce(F.least(part, F.col("shares") - 1), F.lit(0))).drop("shares")
    # Heads are found without their texts, then looked up; one row per chunk.
    first = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("digest").alias("tie"))
    heads = base.groupBy("chunk").agg(F.max(first).alias("first"))
    heads = stage(heads.select("chunk", "first.id", "first.tie", (-F.col("chunk")).alias("place"), F.lit(0).alias("all")), "head-rows")
    last = heads.agg(F.min("chunk").alias("c")).select("c").scalar()
    before = with_previous(heads, ["all"], F.floor(F.col("place") / (10_000 * SHARES)), ["place"], ["chunk"])
    heads = stage(before.select("chunk", "id", "tie", F.coalesce("prev_chunk", last).alias("before")), "heads")
    looked_up = (base.join(heads.withColumnRenamed("chunk", "_chunk"), (F.col("chunk") == F.col("_chunk")) & (F.coalesce("doc_id", F.lit(0)) == F.col("id"))
                           & (F.col("digest") == F.col("tie"))).select(F.col("before").alias("chunk"), "doc_id", "text", "digest")
                 .dropDuplicates(["chunk"]))
    dealt = (base.withColumn("guest", F.lit(False)).unionByName(looked_up.withColumn("guest", F.lit(True)))
             .repartition(max(1, min(n_chunks, 100_000)), "chunk"))
    row = Window.partitionBy("chunk").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("digest"))
    return (dealt.select("chunk", F.row_number().over(row).cast("long").alias("rid"), "doc_id", "text", F.lead("text").over(row).alias("next_text"), "guest")
            .filter(~F.col("guest")).drop("guest"))


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = CHUNK_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document.

    The edited text has its last floor(n / 2) code points replaced by as many (or all) of the next document's, see
    :func:`with_next`. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next; one row per input row. Null text counts as empty; equal texts, and texts with the same set of paragraphs, have
    equal fingerprints. Likeness is shared paragraphs over all paragraphs, exact, 1 for two texts without any.
    """
    half = F.expr("cast(floor(length(text) / 2) as int)")
    windowed = with_next(docs, text, key, rows)
    told = (windowed.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half)))
            .withColumn("da", paragraph_digests(F.col("text"))).withColumn("de", paragraph_digests(F.col("edited")))
            .withColumn("dn", paragraph_digests(F.col("next_text"))))
    told = (told.withColumn("pa", placed_digests(F.col("da"))).withColumn("pe", placed_digests(F.col("de")))
            .withColumn("doc", F.struct(
                "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                fingerprint(F.col("pa")).alias("fingerprint"), fingerprint(F.col("pe")).alias("edited_fingerprint"), "da", "de", "dn")))
    # The finished columns travel with the digests as a record of their own, a key that only one row has: everything stays in
    # the task that the chunk was dealt to, without a join.
    nothing = F.lit(None).cast(told.schema["doc"].dataType)
    record = lambda pair, per_row, digest, side, doc: F.struct(F.lit(pair).alias("pair"), per_row.alias("per_row"), digest.alias("digest"),
                                                               F.lit(side).alias("side"), doc.alias("doc"))

    def item(pair: int, side: int, digest: Column) -> Column:
        return record(pair, F.col(f"cells{pair}"), digest, side, nothing)

    zero = F.lit(0).cast("long")
    parts = [F.array(record(-1, zero, zero, 0, F.col("doc")))]
    for pair, other in enumerate(("de", "dn")):
        for digests, side in (("da", 1), (other, -1)):
            parts.append(F.transform(digests, partial(item, pair, side)))
    items = (told.withColumn("cells0", _cells_per_row(F.col("da"), F.col("de"), 1)).withColumn("cells1", _cells_per_row(F.col("da"), F.col("dn"), 1))
             .select("chunk", "rid", F.explode(F.concat(*parts)).alias("x")).select("chunk", "rid", "x.*"))
    keys = ["chunk", "rid", "pair"]
    both = _peel(items, [*keys, "doc"], 0).groupBy("chunk", "rid").agg(
        F.max("doc").alias("doc"), *[F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}{p}") for p in (0, 1) for c in ("apart", "left")])
    # Only pairs whose first sketch failed keep their digests.
    failed = [F.coalesce(F.col(f"left{p}"), F.lit(0)) > 0 for p in (0, 1)]
    first = stage(both.select(
        "chunk", "rid", *[f"doc.{c}" for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")],
        *[F.size(f"doc.{c}").cast("long").alias(f"n_{c}") for c in ("da", "de", "dn")], *[F.coalesce(f"apart{p}", F.lit(0)).cast("long").alias(f"apart{p}") for p in (0, 1)],
        *[failed[p].alias(f"failed{p}") for p in (0, 1)],
        F.when(failed[0] | failed[1], F.struct("doc.da", "doc.de", "doc.dn")).alias("d")), "sketches")
    retried = first.filter("failed0 or failed1").select("chunk", "rid", F.explode(F.filter(F.array(
        F.when(F.col("failed0"), F.struct(F.lit(0).alias("pair"), F.col("d.da").alias("a"), F.col("d.de").alias("b"))),
        F.when(F.col("failed1"), F.struct(F.lit(1).alias("pair"), F.col("d.da").alias("a"), F.col("d.dn").alias("b")))), lambda x: x.isNotNull())).alias("p")).select("chunk", "rid", "p.*")
    again = differences(retried, keys).groupBy("chunk", "rid").agg(*[F.max(F.when(F.col("pair") == p, F.col("apart"))).alias(f"again{p}") for p in (0, 1)])
    apart = [F.coalesce(f"again{p}", f"apart{p}") for p in (0, 1)]
    return first.join(again, ["chunk", "rid"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("n_da"), F.col("n_de"), apart[0]).alias("near_edited"), likeness(F.col("n_da"), F.col("n_dn"), apart[1]).alias("near_next"))
