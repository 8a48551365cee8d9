"""Operators 11 to 13 against brute force, on odd rows and on empty tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveylens.llm import language_id as LI
from surveylens.llm import lexical_search as LS
from surveylens.llm import spelling as SP
from surveylens.llm.common import load

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------- languages ----

def plain_vector(text, n=3, dimensions=256, seed=5):
    """The bundle of a text, letter by letter."""
    import unicodedata
    text = unicodedata.normalize("NFC", text or "").lower()
    clean = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text)
    clean = " " + " ".join(clean.split()) + " " if clean.strip() else " "
    space, total = LI.LetterSpace(n, dimensions, seed), np.zeros(dimensions, np.int64)
    for i in range(len(clean) - n + 1):
        v = np.ones(dimensions, np.int64)
        for k, c in enumerate(clean[i:i + n]):
            v *= np.roll(space.letter(ord(c))[0].astype(np.int64), n - 1 - k)
        total += v
    return total


def test_language_vectors_equal_letter_by_letter(spark, make_docs, monkeypatch):
    monkeypatch.setattr(LI, "MOST_GRAMS", 7)  # several pieces of n-grams
    texts = ["The cat, the hat!", None, "", "12 %", "x", "É É straße ΣΑΣ", "中文 字 中文字", "a" * 50, "The cat, the hat!"]
    space = LI.LetterSpace(3, 256, 5)
    symbols, doc, lettered = space.symbols(texts)
    got = space.bundle(*space.grams(symbols, doc), len(texts))
    assert lettered.tolist() == [True, False, False, False, True, True, True, True, True]
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == plain_vector(text).tolist(), text
    docs = make_docs([(i, t, "s") for i, t in enumerate(texts)]).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 0, "b").when(F.col("doc_id") == 3, None).otherwise("a"))
    profiles = LI.learn(docs, dimensions=256, seed=5)
    assert profiles.languages == ["a", "b"]
    for name, parity in (("a", 1), ("b", 0)):
        want = sum(plain_vector(t) for i, t in enumerate(texts) if t is not None and i % 2 == parity and i != 3)
        assert profiles.prototypes[profiles.languages.index(name)].tolist() == want.tolist()


def test_language_accuracy_on_held_out_documents(spark):
    docs = load(spark, SF, "documents", "doc_id", "lang")
    found = LI.op11_language_id(spark, SF).join(docs, "doc_id").filter("held_out")
    assert found.count() > 50
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.97
    ids = {r.doc_id for r in found.collect()}
    assert ids == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_language_of_odd_rows(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.when(F.col("doc_id") > 6, "xx").when(F.col("doc_id") > 2, "aa"))
    rows = LI.identify(docs, LI.learn(docs)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[2] == by[3] == by[4] == ("und", 0.0)
    assert by[7][0] in ("aa", "xx") and all(0 <= r.score <= 1 for r in rows)
    clash = docs.withColumn("vector", F.lit(1)).withColumn("score", F.lit("x")).withColumn("i", F.lit(2))
    assert sorted(map(str, LI.identify(clash, LI.learn(clash)).collect())) == sorted(map(str, rows))
    assert LI.identify(docs.limit(0), LI.learn(docs.limit(0))).collect() == []
    nothing = LI.identify(docs, LI.learn(docs.filter("lang IS NULL"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    with pytest.raises(Exception, match="languages"):
        LI.learn(docs, most_languages=1)
    text_ids = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    assert LI.identify(text_ids, LI.learn(docs)).count() == docs.count()
    assert not text_ids.filter(F.col("doc_id").isNull()).select(LI.held_out()).first()[0]


# ---------------------------------------------------------------- search ----

def plain_ranking(docs, items, k):
    """[(item, rank, doc, score)] by scoring every document."""
    import math
    lower = str.maketrans(LS.UPPER, LS.LOWER)

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))

    terms = [(i, Counter(cut(t))) for i, t in docs]
    N, L = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in terms:
            n, score = sum(c.values()), 0
            for t in set(cut(text)) & set(c):
                w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * N // L)))
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("cells,most_terms", [(1 << 22, 4096), (300, 60)])
def test_search_equals_brute_force(spark, make_docs, monkeypatch, cells, most_terms):
    monkeypatch.setattr(LS, "CELLS", cells)  # pieces of a few documents; several blocks of items
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(200)]
    docs += [(300 + i, docs[5][1]) for i in range(30)] + [(7, docs[7][1]), (None, docs[5][1]), (None, None), (400, "")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for k in range(25)]
    items += [(25, docs[5][1]), (26, "nowhere"), (27, None), (28, "W1, w2;W3 w1"), (None, "w2 w5")]
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = make_docs([(i, t, "s") for i, t in docs]).repartition(5).withColumn("n", F.lit("clash"))
    got = LS.rank_documents(frame, table, most_terms=most_terms).collect()
    want = plain_ranking(docs, items, 10)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_search_on_odd_tables(spark, odd_docs):
    items = odd_docs.select(F.col("doc_id").alias("item_id"), "text")
    got = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in LS.rank_documents(odd_docs, items).collect()}
    assert got[9, 1][0] == 9 and got[8, 1][0] == 8
    assert (2, 1) not in got and (3, 1) not in got and (4, 1) not in got
    assert LS.rank_documents(odd_docs.limit(0), items).collect() == []
    assert LS.rank_documents(odd_docs, items.limit(0)).collect() == []
    assert LS.rank_documents(odd_docs.filter("text IS NULL"), items).collect() == []
    text_ids = odd_docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    ids = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in LS.rank_documents(text_ids, items).collect()}
    assert ids[9, 1] == ("d9", got[9, 1][1])


def test_masks_group_equal_rows():
    rng = np.random.default_rng(1)
    bits = rng.random((400, 131)) < 0.02
    first, group = LS.mask_groups(bits)
    assert len(first) == len(np.unique(bits, axis=0))
    assert (bits[first][group] == bits).all()


# -------------------------------------------------------------- spelling ----

def edits_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p + 1:] == b[p + 1:] if len(a) == len(b) else a[p:] == b[p + 1:]


def plain_groups(docs):
    n = Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(str.maketrans(LS.UPPER, LS.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            n[r[:h % len(r)] + r[h % len(r) + 1:] if h % 97 == 0 else r] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if edits_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def noisy_words(rng, roots, size):
    out = []
    for _ in range(size):
        w = rng.choice(roots)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            p = rng.randrange(len(w) + 1)
            w = rng.choice([w[:p] + rng.choice("abé") + w[p:], w[:p] + w[p + 1:], w[:p] + rng.choice("abß") + w[p + 1:]])
        out.append(w.upper() if rng.random() < 0.05 and w.isascii() else w)
    return out


@pytest.mark.parametrize("block_words", [8192, 5])
def test_variants_equal_brute_force(make_docs, monkeypatch, block_words):
    monkeypatch.setattr(SP, "BLOCK_WORDS", block_words)  # blocks that a prefix spans, parts of their queries
    rng = random.Random(11)
    roots = ["abbab", "ababab", "aabbaab", "bananas", "éabaß", "ababababab", "abcdefghijkl", "xabba", "straße"]
    docs = [(i, " ".join(noisy_words(rng, roots, 60)) + ", 12x") for i in range(90)]
    docs += [(3, docs[3][1]), (None, docs[4][1]), (None, None), (200, "")]
    want = plain_groups(docs)
    got = spelled(SP.group_variants(make_docs([(i, t, "s") for i, t in docs]).withColumn("n", F.lit("clash"))))
    assert len(want) > 150 and any(f for f, *_ in want.values())
    assert any(want[f][0] for f, *_ in want.values() if f)  # chains of forms
    assert got == want


def test_scan_list_equals_all_pairs():
    rng = random.Random(2)
    for m in (5, 6, 9):
        words = sorted({"".join(rng.choices("abc", k=k)) for k in (m, m + 1) for _ in range(700)})
        queries = sorted(w for w in words if len(w) == m)
        table, sizes = SP.code_points(words, m + 1), np.array([len(w) for w in words])
        q, i = SP.scan_list(table, sizes, SP.code_points(queries, m), m)
        want = {(a, b) for a in queries for b in words if a[:m // 2] == b[:m // 2] and edits_one(a, b)}
        got = [(queries[a], words[b]) for a, b in zip(q, i, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_prefixes_that_exceed_one_edit():
    rng = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a):
            row, old = [i + 1], row
            for j, d in enumerate(b):
                row.append(min(old[j] + (c != d), old[j + 1] + 1, row[j] + 1))
        return row

    for _ in range(2000):
        prefix, word = ("".join(rng.choices("ab", k=rng.randint(0, 7))) for _ in range(2))
        word = word.ljust(5, "a")
        if min(distance(prefix, word)) <= 1:
            assert SP.within_one(prefix, word)
        elif len(prefix) <= len(word):
            assert not SP.within_one(prefix, word)


def test_variants_of_odd_tables(spark, odd_docs, make_docs):
    assert spelled(SP.group_variants(odd_docs)) == plain_groups([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert SP.group_variants(odd_docs.limit(0)).collect() == []
    assert SP.group_variants(odd_docs.filter("text IS NULL")).collect() == []
    long = "".join(random.Random(1).choices("abcdefg", k=3000))
    docs = [(i, f"{long} {long[:-1]} {long[:1500]}z{long[1500:]}") for i in range(4)] + [(9, long)]
    assert spelled(SP.group_variants(make_docs([(i, t, "s") for i, t in docs]))) == plain_groups(docs)
