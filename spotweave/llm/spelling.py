"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart are equal or one edit apart after that too, so the full
one-edit neighbourhoods of the distinct reduced words, joined with the reduced vocabulary, hold every pair; the pairs are
verified on the words themselves. Distinct reduced words are few and short, so far fewer neighbours are made
than over the whole alphabet. Each unordered pair is generated from one side only.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotweave.llm.common import named
from spotweave.session import stage

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5  # a form occurs at least so many times as often
DAMAGE = 199  # one run in so many loses a code point
SIZES = (6, 12, 24, len(LETTERS))  # symbols of the reduced alphabets; the last one is the alphabet itself
CROWD = 1000  # words that may share a reduced word before the next alphabet is taken
FIRST = 0x21  # symbols are ASCII from here on
JUMPS = 6


def damaged_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", damage: int = DAMAGE) -> DataFrame:
    """Column ``word``, one row per run of letters in the whole texts, A-Z in lower case.

    With ``damage`` d the run loses the code point h % length where d divides h, the unsigned crc32 of ``<id>:<run>``
    (0: no run does). Null texts have none; a null id reads as empty text.
    """
    runs = docs.select(F.coalesce(named(key).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(named(text), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    if not damage:
        return low.select(F.col("run").alias("word"))
    hashed = low.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    return hashed.select(F.when(F.col("h") % damage == 0, F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run"))))
                         .otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with enough code points and occurrences; counts combine before the shuffle."""
    return (words.filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= min_count))


def _symbols(size: int) -> str:
    return "".join(map(chr, range(FIRST, FIRST + size)))


def _reduced(word: Column, size: int) -> Column:
    """The word over ``size`` symbols; characters outside the alphabet share the first."""
    hashed = [i if size == len(LETTERS) else zlib.crc32(c.encode()) % size for i, c in enumerate(LETTERS)]
    symbols = _symbols(size)
    return F.regexp_replace(F.translate(word, LETTERS, "".join(symbols[i] for i in hashed)), f"[^{symbols[0]}-{symbols[-1]}]", symbols[0])


def _neighbours(size: int) -> Column:
    """Reduced words equal to ``r``, shorter by a symbol, or with a symbol replaced by a later one.

    The other half of the neighbourhood, longer words and earlier symbols, is met from the other word of the pair.
    """
    r, later = F.col("r"), _symbols(size)
    places = F.sequence(F.lit(1), F.length("r"))
    head, tail = (lambda i: F.substring(r, F.lit(1), i - 1)), (lambda i: F.substring(r, i + 1, F.length("r")))
    shorter = F.transform(places, lambda i: F.concat(head(i), tail(i)))
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(F.split(F.lit(later), ""), lambda s: s > F.substring(r, i, F.lit(1))), lambda s: F.concat(head(i), s, tail(i)))))
    return F.array_distinct(F.concat(F.array(r), shorter, replaced))


def _alphabet(vocab: DataFrame, sizes: tuple[int, ...], crowd: int) -> int:
    """The smallest alphabet under which no reduced word stands for more than ``crowd`` words."""
    for size in sizes[:-1]:
        most = vocab.groupBy(_reduced(F.col("word"), size).alias("r")).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0]
        if (most or 0) <= crowd:
            return size
    return sizes[-1]


def near_words(vocab: DataFrame, sizes: tuple[int, ...] = SIZES, crowd: int = CROWD) -> DataFrame:
    """(a, b): all unordered pairs of words of ``vocab`` (distinct, column word) that differ by one inserted, deleted or replaced code point.

    The alphabet is the smallest under which reduced words stay distinct enough, so the candidates of a word are bounded by its
    neighbourhood times ``crowd`` whatever its letters are. Null words are left out.
    """
    known = vocab.filter(F.col("word").isNotNull()).select("word")
    size = _alphabet(known, sizes, crowd)
    reduced = stage(known.select("word", _reduced(F.col("word"), size).alias("r")), "spelling-reduced")
    classes = reduced.select("r").distinct()
    met = (classes.select(F.col("r").alias("r_a"), F.explode(_neighbours(size)).alias("r_b"))
           .join(classes.select(F.col("r").alias("r_b")), "r_b"))
    pairs = (met.join(reduced.select(F.col("word").alias("a"), F.col("r").alias("r_a")), "r_a")
             .join(reduced.select(F.col("word").alias("b"), F.col("r").alias("r_b")), "r_b"))
    # Within one reduced word each pair comes from both of its words.
    return (pairs.filter((F.col("r_a") != F.col("r_b")) | (F.col("a") < F.col("b")))
            .filter(F.levenshtein("a", "b", 1) == 1).select("a", "b"))


def group_variants(vocab: DataFrame, ratio: int = RATIO, sizes: tuple[int, ...] = SIZES, crowd: int = CROWD) -> DataFrame:
    """One row per word of ``vocab`` (distinct words with their number n): ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it occurs ``ratio`` times as often as the word, else
    null; ``root`` is where the forms end. Numbers grow at least by ``ratio`` (above 1) from form to form, so forms have no circles. Words without a
    near word have n_near 0 and are their own root. An empty vocabulary stays empty; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form has to occur at least twice as often as its variant")
    counted = stage(vocab.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = stage(near_words(counted, sizes, crowd), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = (both.join(counted.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word"))
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best")))
    joined = counted.join(best, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    chosen = stage(joined.select("word", F.when(fits, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(fits, -F.col("best.less")).alias("form_n")), "spelling-forms")
    # Pointers double each round; 64-bit numbers that at least double end within 64 steps.
    up = chosen.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(JUMPS):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stage(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
    return chosen.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
