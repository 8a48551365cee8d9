"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from surveylens.llm import (licenses, mixing, ngram_join, packing, page_text, quality, secrets, spotsigs,
                            token_counts, vector_search)

SF = "/root/testdata/sf0.001"
WORDS = [a + b + c for a in ("th", "er", "on", "st", "ha") for b in ("an", "ti", "es", "ou") for c in ("", "ly", "ing")]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- 1 quality ----

def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0] * 5 + [1] + [2] * 3)
    u, change = rng.normal(size=9) * 2, -1.3
    p, pairs = quality._forward_backward(u, doc, change)
    expected = 0.0
    for d in range(3):
        at = np.flatnonzero(doc == d)
        weights = {}
        for states in itertools.product((0, 1), repeat=len(at)):
            s = sum(u[i] * z for i, z in zip(at, states))
            weights[states] = np.exp(s + change * sum(a != b for a, b in zip(states, states[1:])))
        total = sum(weights.values())
        for k, i in enumerate(at):
            assert p[i] == pytest.approx(sum(w for z, w in weights.items() if z[k]) / total)
        expected += sum(w * sum(a != b for a, b in zip(z, z[1:])) for z, w in weights.items()) / total
    assert pairs == pytest.approx(expected)


def test_features_do_not_depend_on_slices():
    texts = ["One line.\nTwo two two lines!!\n", "", "A | B\nA | B", "é中 x\n\n y"]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    whole = quality.line_features(np.concatenate(raw), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    for k, r in enumerate(raw):
        x, size, _ = quality.line_features(r, np.array([0, len(r)]))
        assert np.allclose(x, whole[0][whole[2] == k]) and (size == whole[1][whole[2] == k]).all()
    assert x.shape[1] == quality.N_FEATURES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op1_quality_classifier(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_without_labels_every_score_is_a_half(spark, documents):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    scored = quality.score_documents(documents, quality.train(documents, labels))
    assert {round(r.quality_score, 6) for r in scored.collect()} == {0.5}


# ---- 2 licences ----

def test_notices_need_their_key_phrase(make_docs):
    rows = [(1, "x released UNDER the MIT license. And the mit-license again", "a"),
            (2, "Licensed under CC BY-NC 4.0.", "a"), (3, "under the license of MIT", "a"),
            (4, "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met", "a"),
            (5, "GNU General Public License; General Public License", "a"), (6, "worK İ license", "a")]
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 4, 8, "mit")
    assert got[2].labels == "cc-by-nc" and got[2].base_labels == "" and got[2].score == 1.0
    assert got[3].labels == "" and got[3].score == 0.0
    assert got[4].labels == "bsd" and got[5].n_base == 2 and got[6].n_words == 3


def test_rare_words_find_whole_licence_texts(make_docs):
    """Templates by position: whole texts, texts that lack words, and texts with their order undone."""
    rng, rows, want = random.Random(5), [], {}
    for n, (label, notice, key) in enumerate(licenses.NOTICES):
        words, at = notice.split(), licenses._key_start(notice.split(), key.split())
        lead = rng.choices(WORDS, k=rng.randrange(30))
        outside = [i for i in range(len(words)) if not at <= i < at + len(key.split())]
        worn = [("zz" if i in outside[::5] else w) for i, w in enumerate(words)]
        broken = [("zz" if i == at else w) for i, w in enumerate(words)]
        rows += [(3 * n, " ".join(lead + words), "a"), (3 * n + 1, " ".join(lead + worn), "a"),
                 (3 * n + 2, " ".join(lead + broken + ["and"] + sorted(words)), "a")]
        want[3 * n], want[3 * n + 1] = label, label
    got = {r.doc_id: r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    for i, label in want.items():
        places = sum(notice_places(rows[i][1].split(), n) for n in range(len(licenses.NOTICES)))
        assert got[i].n_notices <= places  # a worn text may lack the rare words that it is found by
        if i % 3 == 0:
            assert label in got[i].labels.split(",") and got[i].n_notices == places and got[i].score == 1.0
    for n in range(len(licenses.NOTICES)):
        assert not notice_places(rows[3 * n + 2][1].split(), n)
    assert sum(label in got[i].labels.split(",") for i, label in want.items() if i % 3) >= 0.8 * len(want) / 2


def notice_places(words, n):
    """Places of notice ``n`` in a text: its key phrase whole, 0.6 of its indexed words."""
    _, notice, key = licenses.NOTICES[n]
    own, start = notice.split(), licenses._key_start(notice.split(), key.split())
    kept = [i for i, w in enumerate(own) if w not in licenses.FUNCTION_WORDS]
    in_key = {i for i in kept if start <= i < start + len(key.split())}
    places = 0
    for offset in range(-len(own), len(words)):
        found = {i for i in kept if 0 <= offset + i < len(words) and words[offset + i] == own[i]}
        places += in_key <= found and len(found) >= 0.6 * len(kept)
    return places


# ---- 3 mixing ----

def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * sizes[s] + 1e-9]
        if not over:
            return capped | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mix_reaches_its_targets(make_docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 900))), rng.choice(["b", "a", "a", "a", None, "é", "c"]))
            for i in range(400)]
    rows += [(1000 + i, "few words only", "tiny") for i in range(3)]
    docs = make_docs(rows)
    got = mixing.mix_sources(docs, block_words=64).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    want, source = brute_targets(size), {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.source_size == size[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    out = mixing.mixed_documents(docs, block_words=64).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(abs(words[s] - want[s]) <= 1 for s in want)


def test_shards_hold_the_drawn_counts_of_whole_blocks(make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(f"{i}w{k}" for k in range(rng.randrange(0, 300))), rng.choice(["a", "a", "b", None]))
            for i in range(150)]
    docs, size = make_docs(rows), Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    out = mixing.mixed_shards(docs, block_words=16, shard_blocks=100).collect()
    slots = Counter(r.source for r in out)
    shards = -(-sum(slots.values()) // 100)
    drawn = {}
    names = ["a", "b", None]
    for _, low, _, nos, firsts, counts in mixing.descend(
            20, 100, 1, 0, shards, np.arange(3), np.zeros(3, int), np.array([slots[s] for s in names]), 1):
        for no, first, count in zip(nos.tolist(), firsts.tolist(), counts.tolist()):
            drawn |= {(names[no], j): low for j in range(first, first + count)}
    assert {(r.source, r.slot): r.shard for r in out} == drawn and len(out) == len(drawn)
    per = Counter((r.shard, r.source) for r in out)
    held_by = Counter(r.shard for r in out)  # all shards but the last are full
    assert all(held_by[k] == 100 for k in range(shards - 1)) and held_by[shards - 1] == len(out) - 100 * (shards - 1)
    assert shards > 5 and len({per[k, "a"] for k in range(shards)}) > 1  # not an even deal
    texts, source = {i: t.split() for i, t, _ in rows}, {i: s for i, _, s in rows}
    taken, held = Counter(), {}
    for r in out:
        words = [w for p in r.pieces for w in texts[p.doc_id][p["at"]:p["at"] + p.n]]
        assert len(words) == sum(p.n for p in r.pieces) <= 16 and {source[p.doc_id] for p in r.pieces} == {r.source}
        for p in r.pieces:
            taken[p.doc_id] += p.n
        whole = held.setdefault((r.source, r.block), words)
        longer, shorter = max(whole, words, key=len), min(whole, words, key=len)
        assert longer[:len(shorter)] == shorter
    where = {}
    for r in out:
        for p in r.pieces:
            where.setdefault(p.doc_id, set()).add(r.shard)
    mixed = mixing.mix_sources(docs, block_words=16, shard_blocks=100).collect()
    assert {r.doc_id: (r.taken, r.first_shard, r.n_shards) for r in mixed} == {
        i: (taken[i], min(where.get(i, {None})), len(where.get(i, ()))) for i in texts}
    got = Counter(w for r in mixing.mixed_documents(docs, block_words=16, shard_blocks=100).collect() for w in r.text.split())
    assert got == Counter(w for r in out for p in r.pieces for w in texts[p.doc_id][p["at"]:p["at"] + p.n])
    parts = {(r.shard, p.doc_id, r.slot // -(-size[r.source] // 16)) for r in out for p in r.pieces}
    assert mixing.mixed_documents(docs, block_words=16, shard_blocks=100).count() == len(parts)


def test_reruns_agree(documents):
    a, b = (sorted(map(tuple, mixing.mix_sources(d).collect())) for d in (documents, documents.repartition(7)))
    assert a == b


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1000):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 12345, np.uint64))
        assert sorted(p.tolist()) == list(range(n))
    assert (mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 7, np.uint64)) != np.arange(1000)).any()


def test_tree_splits_all_slots():
    sources, counts = np.array([3, 5, 8]), np.array([10_000, 400, 7])
    leaves = list(mixing.descend(5, 282, 1, 0, 37, sources, np.zeros(3, int), counts, 1))
    assert [x[1] for x in leaves] == list(range(37))
    assert [x[5].sum() for x in leaves] == [282] * 36 + [10_407 - 36 * 282]
    for no, n in zip(sources, counts):
        own = [(x[4][x[3] == no][0], x[5][x[3] == no][0]) for x in leaves if no in x[3]]
        assert [f for f, _ in own] == list(itertools.accumulate([0] + [c for _, c in own[:-1]]))
        assert sum(c for _, c in own) == n


def test_shard_counts_follow_the_multinomial_law():
    draws = np.array([mixing.drawn(np.random.default_rng(k), np.array([600, 300, 100]), 100) for k in range(3000)])
    share = np.array([0.6, 0.3, 0.1])
    assert (draws.sum(1) == 100).all() and np.allclose(draws.mean(0), 100 * share, atol=0.4)
    # variances of draws without return, given the sources' totals
    assert np.allclose(draws.var(0), 100 * share * (1 - share) * 900 / 999, rtol=0.12)
    huge = np.array([6 * 10**9, 3 * 10**9, 5, 0])
    left = mixing.drawn(np.random.default_rng(1), huge, 4 * 10**9)
    assert left.sum() == 4 * 10**9 and (left >= 0).all() and (left <= huge).all()
    assert np.allclose(left[:2] / 4e9, [2 / 3, 1 / 3], atol=1e-4)


# ---- 4 packing ----

def test_pieces_are_an_exact_round_trip(documents):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
           for r in documents.collect()}
    pieces = packing.pack(documents, partitions=3).collect()
    at, filled = Counter(), Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        own = ids[p.doc_id]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(own)
        assert p.ids_crc32 == zlib.crc32(own[p.start:p.start + p.length].tobytes())
        at[p.doc_id] += p.length
    assert all(at[d] == len(i) for d, i in ids.items())
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id]
        filled[p.sequence_id] += p.length
    assert all(n == 4096 or n & (n - 1) == 0 and n < 4096 for n in filled.values())


def test_word_ids_equal_the_whole_tokenizer():
    import public_tokenizers
    import pyarrow as pa
    from surveylens.llm.word_tokens import WordTokens
    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["It's 2 o'clock!!! don't", None, "", "ÀÉ Straße\xa0x İstanbul ΑΣ é 中文字 \U0001f600", "a\x00b\x1fc <|endoftext|> &&&***",
             "x" * 300, " \t lead  and trail \r\n", "½ ² µ ª 12345 'll've"]
    ids, n = tokens.encode(pa.array(texts, pa.string()), 2)
    at = 0
    for t, k in zip(texts, n):
        assert ids[at:at + k].tolist() == tokens.full.encode(t or "", add_special_tokens=False).ids + [2]
        at += k


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        number = packing.hilbert(cells, bits)
        assert sorted(number.tolist()) == list(range(len(cells)))
        along = cells[np.argsort(number)]
        assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


# ---- 5 fingerprints ----

def test_edited_texts_and_likeness(documents):
    rows = sorted((r.doc_id, r.text or "") for r in documents.collect())
    got = {r.doc_id: r for r in spotsigs.edited_likeness(documents).collect()}
    parts = {i: (lambda h: {h[k:k + 16] for k in range(0, len(h), 16)})(r.fingerprint.split(":")[1]) for i, r in got.items()}
    by_text = {}
    for k, (i, t) in enumerate(rows):
        j, following = rows[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[i]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert r.near_next == pytest.approx(len(parts[i] & parts[j]) / len(parts[i] | parts[j]))
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if edited == t:
            assert r.near_edited == 1.0 and r.edited_fingerprint == r.fingerprint


def test_signatures_follow_anchors(spark):
    df = spark.createDataFrame([("The old mill was near the quiet river bank",), ("no anchors here",), ("",)], "t string")
    n = [r.n for r in spotsigs.with_signatures(df, F.col("t"), "s").select(F.size("s").alias("n")).collect()]
    assert n == [3, 1, 1]  # the:old:mill, was:near:quiet, the:quiet:river


@pytest.mark.parametrize("num", [44, 80, 100])
def test_near_duplicates_equal_brute_force(spark, make_docs, documents, num):
    rng = random.Random(num)
    common = "the is a was der und le es".split()
    base = [[rng.choice(common) + " " + " ".join(rng.choices(WORDS, k=2)) for _ in range(rng.randrange(1, 40))]
            for _ in range(30)]
    texts = [" ".join(b[:k] + rng.choices(rng.choice(base), k=len(b) - k))
             for b in base for k in {len(b), len(b) * 9 // 10, len(b) * 3 // 4, len(b) // 2}]
    texts += texts[:9] + ["", "", "no anchors"] + [r.text or "" for r in documents.limit(60).collect()]
    docs = make_docs(list(zip(rng.sample(range(1000), len(texts)), texts, ["s"] * len(texts))))
    sets = {r.doc_id: frozenset(r.signatures) for r in spotsigs.fingerprints(docs).collect()}
    head = {}
    for i in sorted(sets):
        head.setdefault(sets[i], i)
    want = {(head[s], i): 1.0 for i, s in sets.items() if head[s] != i}
    for (a, i), (b, j) in itertools.combinations(head.items(), 2):
        if len(a & b) * 100 >= len(a | b) * num:
            want[min(i, j), max(i, j)] = len(a & b) / len(a | b)
    out = spotsigs.near_duplicates(docs, num=num).collect()
    got = {(min(r[:2]), max(r[:2])): r.likeness for r in out}
    assert len(got) == len(out) and got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p]) for p in want)
    assert num == 100 or any(not r.copy for r in out)
    links = Counter(x for p in want if sets[p[0]] != sets[p[1]] for x in p)
    classes = {r.doc_id: (r.class_doc_id, r.n_links) for r in spotsigs.near_duplicate_classes(docs, num=num).collect()}
    assert classes == {i: (head[s], links[head[s]]) for i, s in sets.items()}


def test_partners_are_in_the_own_or_the_next_partition():
    for num in (1, 44, 80, 99, 100):
        bounds = spotsigs.length_bounds(300, num, 100)
        part = [sum(b <= n for b in bounds) for n in range(301)]
        assert all(part[z] <= part[a] + 1 for a in range(1, 301) for z in range(a, 301) if a * 100 >= z * num)


# ---- 6 token counts ----

def brute_sections(text, tokenizer):
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text) or [""]
    raw, counts, ends = text.encode(), [0] * len(lines), list(itertools.accumulate(len(x.encode()) for x in lines))
    at = 0
    for token in tokenizer(text):
        span = range(at, at + len(token))
        at += len(token)
        own = Counter(next(k for k, e in enumerate(ends) if b < e) for b in span)
        counts[max(own, key=lambda k: (own[k], -k))] += 1
    assert at == len(raw)
    return counts


def test_counts_equal_brute_force(make_docs):
    encoding, _ = token_counts.load_encoding(token_counts.tokenizer_path(token_counts.TOKENIZER))
    texts = ["One line.\n\n\nTwo lines\n", "a\n\n  b", "é中\n\U0001f600 x\n", "", "no break", "\n\n\n\n"]
    got = {}
    for r in token_counts.count_tokens(make_docs([(i, t, "s") for i, t in enumerate(texts)])).collect():
        got.setdefault(r.doc_id, {})[r.section] = r
    for i, t in enumerate(texts):
        want = brute_sections(t, lambda x: [encoding.decode_single_token_bytes(k) for k in encoding.encode_ordinary(x)])
        assert [got[i][k].n_tokens for k in sorted(got[i])] == want
        assert sum(r.n_chars for r in got[i].values()) == len(t)


def test_long_blank_runs_have_the_same_ids():
    encoding, _ = token_counts.load_encoding(token_counts.tokenizer_path(token_counts.TOKENIZER))
    other = token_counts.same_vocabulary(token_counts.tokenizer_path(token_counts.SAME_VOCABULARY))
    text = "a" + " " * 6000 + "b\n" + "é" * 50
    assert token_counts.encode_whole(text, encoding, lambda: other).tolist() == encoding.encode_ordinary(text)


# ---- 7 n-gram join ----

def brute_groups(texts, n, num):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("n, num, frequent", [(3, 90, 4), (5, 80, 4), (3, 90, 50), (2, 60, 3)])
def test_groups_equal_brute_force(make_docs, n, num, frequent):
    rng = random.Random(n * num)
    passage = rng.choices(WORDS, k=40)
    texts = {}
    base = [rng.choices(WORDS, k=rng.randrange(60, 140)) for _ in range(4)]
    for i in range(260):
        kind = i % 5
        if kind < 3:  # large groups of near copies, with few to many edits
            w = list(base[rng.choice([0, 0, 0, 1, 2, 3])])
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = rng.choice(WORDS) + (str(i) if rng.random() < 0.5 else "")
            w = w[:len(w) - rng.randrange(0, 6)]
        elif kind == 3:  # a shared passage in texts of their own
            w = rng.choices(WORDS, k=rng.randrange(3, 60)) + passage + rng.choices(WORDS, k=rng.randrange(3, 60))
        else:
            w = rng.choices(WORDS, k=rng.randrange(0, 12))
        texts[i] = " ".join(w)
    got = ngram_join.near_duplicate_groups(make_docs([(i, t, "s") for i, t in texts.items()]), n=n, num=num,
                                           frequent=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(texts, n, num)


def test_one_row_of_each_group_stays(make_docs):
    same = " ".join(WORDS[:30])
    docs = make_docs([(4, same, "a"), (2, same, "a"), (2, same, "a"), (7, "other words entirely here now", "b"),
                      (9, "", "b"), (None, same, "c")])
    assert sorted(r.doc_id for r in ngram_join.one_of_each_group(docs).collect() if r.doc_id is not None) == [2, 7, 9]


# ---- 8 nearest neighbours ----

def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 2
    x = (centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    x[500:900] = x[500]  # a very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16),
                                                        (9300, [1.0] * 3), (9400, [None] * 16), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    out = vector_search.nearest_neighbours(df, F.col("id") % 100 == 0, block=256, list_size=64).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == list(range(0, 3000, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        hits += len(set(order) & {r.vec_id for r in found})
        assert [r.rank for r in found] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], abs=1e-12) for r in found)
        if 500 <= q < 900:
            assert [r.vec_id for r in found] == order
    assert hits / (10 * len(got)) >= 0.9


def test_query_blocks_are_bounded_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))],
                               "vec_id long, embedding array<double>")
    whole = vector_search.nearest_neighbours(df, F.col("id") % 2 == 0, list_size=200, block=64).collect()
    sizes = spark.sparkContext.accumulator(0)
    plain = type(df.groupBy("vec_id").cogroup(df.groupBy("vec_id"))).applyInPandas

    def checked(groups, search, schema):
        def counted(q, p):
            sizes.add(int(len(q) > 60))
            return search(q, p)
        return plain(groups, counted, schema)

    monkeypatch.setattr(type(df.groupBy("vec_id").cogroup(df.groupBy("vec_id"))), "applyInPandas", checked)
    parts = vector_search.nearest_neighbours(df, F.col("id") % 2 == 0, list_size=200, block=64, query_block=30).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(parts) == 3000
    assert sizes.value == 0


def test_graph_walk_and_bound_against_brute_force():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16))
    index = vector_search.ListIndex.build(x, 300)
    d = np.sqrt(vector_search._square_distances(x[:200], index.centroids))
    far, at = index.nearest(x[:200], 24)
    assert (np.diff(far, axis=1) >= 0).all() and np.allclose(far, np.take_along_axis(d, at, 1))
    assert all(len(set(row)) == len(row) for row in at.tolist())
    assert (at[:, 0] == d.argmin(1)).mean() >= 0.95
    every, numbers = index.nearest(x[:5], 10_000)
    assert np.allclose(every, np.sort(d[:5], axis=1)) and numbers.shape == d[:5].shape
    far, at = vector_search.nearest_of(x[:50], x[100:2000], 11)
    d = np.sqrt(vector_search._square_distances(x[:50], x[100:2000]))
    assert np.allclose(np.sort(far, axis=1), np.sort(d, axis=1)[:, :11]) and np.allclose(far, np.take_along_axis(d, at, 1))
    assert vector_search.nearest_of(x[:3], x[:5], 11)[0].shape == (3, 5)


def test_few_vectors_are_all_returned(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    out = vector_search.nearest_neighbours(df, F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out, key=lambda r: r.rank)] == [(100, 1, 2), (100, 2, 1)]
    assert vector_search.nearest_neighbours(df.limit(0), F.col("id") % 100 == 0).collect() == []


# ---- 9 secrets ----

def test_forest_drops_false_positives(spark, make_docs):
    rng = random.Random(3)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    rows = [(i, f'the words {" ".join(rng.choices(WORDS, k=5))} token = "{h}" and more', "s") for i, h in enumerate(hexes[:29])]
    rows += [(29, f"password={hexes[29]} in a file", "s")]
    rows += [(100 + i, f"commit {h} fixed the build", "s") for i, h in enumerate(hexes[30:])]
    rows += [(200 + i, "a card 4734663219866878 and thinghationtheouring or some.one77@mail.example.com now", "s") for i in range(20)]
    out = secrets.scan_secrets(make_docs(rows)).collect()
    assert {r.doc_id for r in out if r.is_secret} == set(range(30))
    marked = {r.doc_id: r.text for r in secrets.redact_secrets(make_docs(rows)).collect()}
    assert all(secrets.MARK in marked[i] and hexes[i] not in marked[i] for i in range(30))
    assert marked[100] == rows[30][1] and marked[200] == rows[60][1]


def test_short_values_and_all_matches_are_candidates(make_docs):
    docs = make_docs([(1, "password = hunter2xY9 is set", "s"), (2, 'the github_token: "ab12cd34ef"', "s"),
                      (3, "the password is q8w7e6r5t4", "s"), (4, "a shortword and plain words", "s"),
                      (5, "db.password:hunter3xY9 here", "s"), (6, "see 1234567890abcdefg%zyx9876543210abcd end", "s"),
                      (7, "key$3x4mpl3one$4nother2two", "s"), (8, "secret = 3x4mpl3one$4nother2two", "s")])
    got = {}
    for r in secrets.candidate_rows(docs, "doc_id", "text", "source").collect():
        got.setdefault(r.id, []).append(r.value)
    assert got == {1: ["hunter2xY9"], 2: ["ab12cd34ef"], 3: ["q8w7e6r5t4"], 5: ["hunter3xY9"],
                   6: ["1234567890abcdefg", "zyx9876543210abcd"], 8: ["3x4mpl3one", "4nother2two"]}


def test_credential_names_are_parts_of_key_names(make_docs):
    yes = ["github_token", "db_password", "aws_access_key_id", "API-KEY", "accessKeyId", "clientSecret", "key", "auth"]
    no = ["tokenizer", "secretary", "monkey", "keyboard", "author", "commit", "passenger"]
    docs = make_docs([(i, f'{n} = "k3J9x2L8q4W7z1"', "s") for i, n in enumerate(yes + no)])
    rows = secrets.add_features(secrets.candidate_rows(docs, "doc_id", "text", "source"), [])
    got = {r.id: (r.credential, r.near_credential) for r in rows.collect()}
    assert got == {i: (1.0, 1.0) if i < len(yes) else (0.0, 0.0) for i in range(len(yes + no))}


def test_forest_from_findings_on_held_out_findings(make_docs):
    """Credential names stand before placeholders as well as secrets, and some secrets have none."""
    rng = random.Random(11)
    signs = "abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"

    def key(n):
        return "".join(rng.choices(signs, k=n - 2)) + "7Q"

    kinds = [(1, lambda: f"{rng.choice(['db_password', 'api_key'])} = {key(14)} in the file"),
             (1, lambda: f"please call it with {key(24)} for now"),
             (0, lambda: f"{rng.choice(['db_password', 'api_key'])} = {'_'.join(rng.choices(WORDS, k=3))}_{rng.randrange(9)} in the file"),
             (0, lambda: "commit " + "".join(rng.choices("0123456789abcdef", k=40)) + " fixed the build"),
             (0, lambda: f"see {'/'.join(rng.choices(WORDS, k=4))}.py for now")]
    rows = [(i, f"{' '.join(rng.choices(WORDS, k=20))} {kinds[i % 5][1]()}", "s") for i in range(400)]
    docs, truth = make_docs(rows), F.element_at(F.array(*[F.lit(float(y)) for y, _ in kinds]),
                                                (F.col("id") % 5 + 1).cast("int"))
    findings = (secrets.candidate_rows(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "source")
                .withColumn("label", truth).drop("id", "at"))
    out = [r for r in secrets.scan_secrets(docs, findings=findings).collect() if r.doc_id % 2]
    assert {r.doc_id for r in out if kinds[r.doc_id % 5][0]} == {i for i in range(1, 400, 2) if kinds[i % 5][0]}
    said = [(r.is_secret, kinds[r.doc_id % 5][0] == 1, r.credential == 1) for r in out]
    right = sum(a and b for a, b, _ in said)
    assert right >= 0.95 * sum(a for a, _, _ in said) and right >= 0.95 * sum(b for _, b, _ in said)
    # a rule on the name alone would be wrong on both kinds
    assert any(a and not c for a, _, c in said) and any(c and not a for a, _, c in said)


def test_dictionary_counts_the_words_of_all_documents(make_docs):
    docs = make_docs([(1, "the river (meadow) ran.", "s"), (2, None, "s"), (3, "x9abc/def abcd1 wxyz-q", "s")])
    triples = {w[k:k + 3] for w in ("the", "river", "meadow", "ran") for k in range(len(w) - 2)}
    assert secrets.dictionary(docs, "text") == sorted(triples)


def test_short_passwords_are_redacted(make_docs):
    rng = random.Random(4)
    keys = ["".join(rng.choices("abcdefghjkmnpqrstuvwxyz", k=6)) + "".join(rng.choices("0123456789", k=3)) + "X" for _ in range(40)]
    rows = [(i, f"{rng.choice(['db_password', 'github_token'])} = {k} in a file", "s") for i, k in enumerate(keys)]
    rows += [(100 + i, f"Note: {' '.join(rng.choices(WORDS, k=30))} of thingstouring", "s") for i in range(40)]
    marked = {r.doc_id: r.text for r in secrets.redact_secrets(make_docs(rows)).collect()}
    assert all(keys[i] not in marked[i] and secrets.MARK in marked[i] for i in range(40))
    assert all(marked[100 + i] == rows[40 + i][1] for i in range(40))


# ---- 10 pages ----

def test_page_text():
    page = ("<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a>menu</a></nav>"
            "<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p>One <b>bold</b>word.<br>Next<p>Sho&#114;t."
            "<div class='comments'><p>reader says</p></div><form>f<p>x</form></article><footer>&copy; f</footer>")
    assert page_text.main_text(page) == "Head & line One boldword. Next Short."
    assert page_text.main_text(None) == "" and page_text.main_text("<nav>x</nav>") == ""
    plain = ("<body><div id=menu><a>a</a></div><div class=content><p>" + "Long text of a paragraph. " * 9
             + "<p>Tiny.<p>" + "More text that is long. " * 9 + "</div><div class=footer>foot</div>")
    text = page_text.main_text(plain)
    assert "Tiny." in text and "foot" not in text and text.startswith("Long text")


def test_pages_equal_their_articles(spark):
    import html
    for r in page_text.op10_html_extraction(spark, SF).join(
            spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S).group(1)
        want = html.unescape(re.sub(r"<[^>]*>?", lambda m: "" if re.match(r"</?b>", m.group()) else " ", inner))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)


# ---- the pipeline ----

def test_pipeline_stages(spark, documents):
    docs, labels = documents, spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "curve_packing":
            assert out.schema.simpleString() == documents.schema.simpleString()
        kept = pipeline.materialise(out, "test-stage")
        if name == "quality_classifier":  # clean documents stay
            lost = docs.join(labels.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi").select("doc_id") \
                .exceptAll(kept.select("doc_id")).count()
            assert lost == 0
        if name == "ngram_join":
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert {r.doc_id for r in kept.collect()} == {c for _, c in brute_groups(texts, 5, 80).values()}
        docs = kept
    assert docs.count() > 0
