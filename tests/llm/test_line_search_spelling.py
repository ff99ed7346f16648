"""Line dedup, lexical search and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from spotweave.llm import lexical_search, line_dedup, spelling
from spotweave.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"
ASCII = {c: c + 32 for c in range(65, 91)}


def plain_lines(rows, min_docs=2, min_chars=10):
    """(id, text) rows to (id, kept text, lines, dropped)."""
    holders = defaultdict(set)
    keys = [[(line, line.strip(BLANK).translate(ASCII)) for line in (t or "").split("\n")] for _, t in rows]
    for (doc, _), lines in zip(rows, keys):
        for _, key in lines:
            if len(key) >= min_chars:
                holders[key].add(math.inf if doc is None else doc)
    out = []
    for (doc, _), lines in zip(rows, keys):
        left = [line for line, key in lines if len(holders[key]) < min_docs or min(holders[key]) == (math.inf if doc is None else doc)]
        out.append((doc, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["Shared line of text", "  shared LINE of text\r", "\tÉtat partagé ici", "État partagé ici", "état partagé ici", "short", "", "  ", " a line with its own ",
            "nine char", "ten  chars", " separators\x85here"]
    texts = ["\n".join(rng.choice(pool + [f"own line {i} {k}"]) for k in range(rng.randrange(1, 9))) for i in range(60)]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, None), (4, ""), (5, "\n\n"), (6, "Shared line of text\n" * 20_000)]
    rows += rows[:6] + [(90, "only copies held\nten  chars"), (91, "only copies held\nten  chars")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, n_lines string, line string, lost string")
    got = line_dedup.drop_shared_lines(docs)
    assert got.columns == ["doc_id", "text", "line", "lost", "n_lines", "n_dropped"]
    found = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert by_text(found) == by_text(plain_lines(rows)) and {r["lost"] for r in got.collect()} == {"z"}
    thrice = line_dedup.drop_shared_lines(docs, min_docs=4, min_chars=1)
    assert by_text((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in thrice.collect()) == by_text(plain_lines(rows, 4, 1))
    assert line_dedup.drop_shared_lines(docs.limit(0)).count() == 0


def test_line_dedup_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = [(r["doc_id"], r["kept_sha256"], r["n_lines"], r["n_dropped"]) for r in QUERIES["op11_line_dedup"](spark, sf_dir).collect()]
    assert by_text(found) == by_text((d, hashlib.sha256(t.encode()).hexdigest(), n, k) for d, t, n, k in plain_lines(rows))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=10):
    """(item, rank, id, score) by definition."""
    counts = [(d, Counter(TERM.findall((t or "").translate(ASCII)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in counts:
            m = 25 + 75 * c.total() * n // length
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                                for t in TERM.findall((text or "").translate(ASCII)) if c[t]), math.inf if doc is None else doc))
        out += [(item, k + 1, None if doc == math.inf else doc, -s) for k, (s, doc) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return out


@pytest.mark.parametrize("part_docs,part_terms,first", [(3, 1 << 20, 1), (100, 7, 2), (4096, 1 << 20, 4)])
def test_lexical_search(spark, part_docs, part_terms, first):
    rng = random.Random(9)
    words = ["the", "Of", "état", "x1", "日本", "rare", "zinc", "under_score", "naïve", "QUARK"]
    texts = [" ".join(rng.choices(words, weights=[30, 20, 5, 5, 5, 1, 1, 3, 2, 1], k=rng.choice([1, 3, 3, 8, 20]))) for _ in range(150)]
    docs = [(None if i % 29 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " -- "), (903, "the zinc " * 30_000)]
    docs += [(1000 + i, "copy of the rare zinc") for i in range(40)] + docs[5:9]
    items = [(1, "The rare zinc"), (1, "The rare zinc"), (1, "quark quark x1"), (2, None), (3, "nowhere"), (None, "of état 日本"), (5, "COPY, copy; naïve under"), (6, "")]
    frame = spark.createDataFrame([(d, t, "a", 1) for d, t in docs], "doc_id long, text string, term string, m long").repartition(5)
    asked = spark.createDataFrame([(i, t, "b") for i, t in items], "item_id long, text string, rank string")
    index = lexical_search.build_index(frame, part_docs=part_docs, part_terms=part_terms)
    found = [tuple(r) for r in lexical_search.search(index, asked, first_parts=first).collect()]
    assert by_text(found) == by_text(plain_search(docs, items))
    assert by_text(map(tuple, lexical_search.search(index, asked, top=3, first_parts=first).collect())) == by_text(plain_search(docs, items, 3))
    if first == 4:
        assert lexical_search.search(index, asked.limit(0)).count() == 0
        assert lexical_search.search(lexical_search.build_index(frame.limit(0)), asked).count() == 0


def test_every_row_is_indexed(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = lexical_search.build_index(docs)
    held = [d for r in index.parts.collect() for d in r["ids"]]
    assert sorted(held) == sorted(r["doc_id"] for r in docs.collect() if TERM.search(r["text"] or "")) and index.docs == len(held)


def test_items_meet_parts_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE_ITEMS", 3)
    docs = [(i, f"word{i % 7} word{i % 5} common") for i in range(50)]
    items = [(i, f"word{i % 7} common word{i % 3}") for i in range(20)]
    index = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string"), part_docs=8)
    found = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), first_parts=1).collect()
    assert by_text(map(tuple, found)) == by_text(plain_search(docs, items))


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_variants(counts, ratio=5):
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o))
        if counts[best] >= ratio * counts[word]:
            form[word] = best
    out = []
    for word in words:
        root = word
        while root in form:
            root = form[root]
        out.append((word, form.get(word), root, counts[word], len(near[word]), counts[form[word]] if word in form else None))
    return out


@pytest.mark.parametrize("sizes,crowd", [(spelling.SIZES, 1000), (spelling.SIZES, 1), ((1, 2), 50), ((2, 90), 10**9)])
def test_variants(spark, sizes, crowd):
    rng = random.Random(3)
    base = ["kitten", "sitting", "aaaaaa", "ababab", "straße", "élevée", "日本語文字列", "a-b-c!12"]
    words = set(base)
    for word in base * 40:
        for _ in range(rng.randrange(1, 3)):
            i, c = rng.randrange(len(word)), rng.choice("abtés日1!z")
            word = rng.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:]])
        words.add(word)
    counts = {w: rng.choice([1, 1, 2, 5, 6, 25, 30, 125, 700, 10**6]) for w in words}
    vocab = spark.createDataFrame([(w, n, "x", "y") for w, n in counts.items()] + [(None, 4, "x", "y")], "word string, n long, form string, r string")
    found = [tuple(r) for r in spelling.group_variants(vocab, sizes=sizes, crowd=crowd).collect()]
    assert sorted(found) == sorted(plain_variants(counts), key=lambda r: r[0])


def test_long_chains_of_forms(spark):
    counts = {"a" * (k + 1): 2 ** k for k in range(40)}
    found = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), ratio=2).collect()
    assert {r["root"] for r in found} == {"a" * 40}
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def plain_words(docs, damage=199):
    words = []
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words.append(run)
    return words


def test_words(spark):
    docs = [(1, None), (2, ""), (None, "Über-État x×y ÷ ÀB"), (3, "word " * 50_000), (3, "word"), (4, "A1b2C3 Āa"), *[(10 + i, "Damaged runs lose É") for i in range(60)]]
    frame = spark.createDataFrame([(d, t, "w") for d, t in docs], "doc_id long, text string, word string")
    for damage in (0, 5, 199):
        assert Counter(r["word"] for r in spelling.damaged_runs(frame, damage=damage).collect()) == Counter(plain_words(docs, damage))


def test_spelling_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: n for w, n in Counter(plain_words(docs)).items() if n >= 5 and len(w) >= 6}
    found = [tuple(r) for r in QUERIES["op13_spelling"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert sorted(found, key=str) == sorted(plain_variants(counts), key=str) and any(r[1] for r in found)
