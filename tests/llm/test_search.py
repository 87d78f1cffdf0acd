"""Spelling variants, nearest vectors and ranked search against brute-force versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaespark.llm import multiindex, ranked, spelling

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- spelling variants -------------------------------------------------------------------

def near(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def variants_of(rows, least_chars=6, least_times=5, every=199, times=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_chars and c >= least_times}
    beside = {w: [t for t in n if near(w, t)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda t: (-n[t], t), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(beside[w]), n.get(form[w])) for w in n}


def mutated(rng, word):
    at, c = rng.randrange(len(word)), rng.choice("abé")
    return rng.choice([word[:at] + word[at + 1:], word[:at] + c + word[at:], word[:at] + c + word[at + 1:]])


def test_variants_match_brute_force(frame):
    rng = random.Random(2)
    stems = ["aabbaa", "bananas", "Écoleàß", "mississippi", "zzzzzzz", "÷×÷×÷×÷"] + ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(15)]
    rows = []
    for k in range(120):
        picked = [rng.choice(stems) for _ in range(30)]
        rows.append((k % 110 if k else None, " ".join(mutated(rng, w) if rng.random() < 0.3 else w for w in picked)))
    rows += [(200, None), (201, ""), (202, "12 ...\n"), (203, "Bananas bananas, BANANAS"), (203, "Bananas bananas, BANANAS")]
    for every in (199, 3):
        got = spelling.variants(frame(rows), every=every)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        want = variants_of(rows, every=every)
        assert len(want) > 40 and any(w[1] is not None for w in want)
        assert {tuple(r) for r in got.collect()} == want


def test_words_beyond_the_trie_meet_at_deletion_keys(frame):
    """Words around the trie's depth, and of a few thousand letters in a long text."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef") for _ in range(spelling.DEEPEST))
    words = [base, base[:-1], base + "q", base[:20] + "q" + base[20:], base[:-3] + "qq" + base[-1:], "x" + base[1:], "x" * 3000, "x" * 3001, "y" + "x" * 2999]
    text = " ".join(w for k, w in enumerate(words) for _ in range(6 + 40 * (k % 2)))
    assert {tuple(r) for r in spelling.variants(frame([(1, text)]), every=10**10).collect()} == variants_of([(1, text)], every=10**10)


def test_each_pair_is_found_once(spark):
    words = ["".join(x) for x in np.random.default_rng(1).choice(list("ab"), (60, 7))] + ["".join(x) for x in np.random.default_rng(2).choice(list("ab"), (60, 6))]
    words = sorted(set(words))
    got = [tuple(r) for r in spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_variants_of_nothing(frame):
    for rows in ([], [(1, None)], [(1, "to be or not")]):
        assert spelling.variants(frame(rows)).collect() == []


# --- ranked search -----------------------------------------------------------------------

def ranking(docs, items, k):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    full = [w for w in terms if w]
    n_docs, total = len(full), sum(map(len, full))
    df, out = Counter(t for w in full for t in set(w)), []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for (doc, _), w in zip(docs, terms):
            if not w:
                continue
            tf, m = Counter(w), 10 + 90 * len(w) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked & set(tf))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if missing else doc, -s) for r, (s, missing, doc) in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture
def corpus():
    rng = random.Random(8)

    def text(n):
        return " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))

    docs = [(k, text(rng.choice([1, 3, 20, 60]))) for k in range(300)]
    docs += [(7, "w1 w2 w3 W4"), (7, "w1 w2 w3 W4"), (None, "w5 w6 w299"), (900, None), (901, ""), (902, " .;\n"), (903, "w3 " * 4000), (904, "Ünï w1 日本")]
    items = [(k, text(rng.choice([1, 2, 8, 30]))) for k in range(25)] + [(25, None), (26, "!"), (27, "nowhere"), (3, "w1 w1 W1"), (None, "w2 w9"), (28, "Ünï w1 日本 w5 w299")]
    return docs, items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes, shard_docs", [(32_000_000, 1 << 16), (600, 1 << 16), (1 << 20, 7)])
def test_ranks_match_brute_force(frame, spark, corpus, monkeypatch, shard_bytes, shard_docs):
    monkeypatch.setattr(ranked, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(ranked, "SHARD_DOCS", shard_docs)
    docs, items = corpus
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    for k in (1, 10):
        got = ranked.rank(frame(docs), queries, k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert rows_of(got) == sorted(ranking(docs, items, k), key=str)


def test_blocks_of_queries_give_the_same(frame, spark, corpus, monkeypatch):
    docs, items = corpus
    queries = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 600)
    assert rows_of(ranked.rank(frame(docs), queries, 10)) == sorted(ranking(docs, items, 10), key=str)


def test_ranks_without_rows(frame, spark):
    queries = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert ranked.rank(frame([]), queries).collect() == []
    assert ranked.rank(frame([(1, None), (2, "")]), queries).collect() == []
    assert ranked.rank(frame([(1, "w1")]), queries.limit(0)).collect() == []


def shard_of(rng, docs=200, terms=12):
    """A shard of random lists, with pairs that hardly ever occur together."""
    weights = np.array(sorted(rng.integers(1, 2000, terms).tolist()), np.int64)
    held = rng.random((terms, docs)) < rng.uniform(0.02, 0.6, (terms, 1))
    for t in range(0, terms - 1, 2):
        held[t + 1] &= ~held[t] | (rng.random(docs) < 0.05)
    held[np.arange(terms), rng.integers(0, docs, terms)] = True
    parts = np.where(held, rng.integers(1, 1000, (terms, docs)), 0)
    lists = [np.flatnonzero(p) for p in parts]
    starts = np.cumsum([0, *map(len, lists)])
    pairs = [(t, t + 1) for t in range(terms - 1)]
    both = [np.intersect1d(lists[a], lists[b]) for a, b in pairs]
    sums = [weights[a] * parts[a][p] + weights[b] * parts[b][p] for (a, b), p in zip(pairs, both)]
    shard = ranked.Shard({
        "ids": list(range(docs)), "terms": np.arange(terms).astype("<i4").tobytes(), "starts": starts.astype("<i8").tobytes(),
        "places": np.concatenate(lists).astype("<u2").tobytes(), "parts": np.concatenate([parts[t][x] for t, x in enumerate(lists)]).astype("<u4").tobytes(),
        "tops": parts.max(axis=1).astype("<u4").tobytes(), "pairs": np.array(pairs, "<i4").tobytes(),
        "pair_starts": np.cumsum([0, *map(len, both)]).astype("<i8").tobytes(), "pair_places": np.concatenate(both).astype("<u2").tobytes(),
        "joint": np.array([s.max(initial=0) for s in sums], "<i8").tobytes(), "kth": np.zeros(len(pairs), "<i8").tobytes()}, weights)
    return shard, weights[:, None] * parts


def test_bounds_never_lose_a_document_and_pairs_tighten_them():
    rng = np.random.default_rng(5)
    looked_at, alone, opened_some = 0, 0, 0
    for _ in range(150):
        shard, impacts = shard_of(rng)
        terms, totals = list(range(len(impacts))), impacts.sum(axis=0)
        least = int(np.sort(totals)[-rng.integers(1, 12)])
        essential, rest, bounds, opened = ranked.split(shard, terms, least)
        covered = (impacts[essential] > 0).any(axis=0) if essential else np.zeros(shard.n, bool)
        for pair in opened:
            covered[shard.both(pair)] = True
        assert not (~covered & (totals >= least)).any()
        for n, bound in enumerate(bounds):
            assert impacts[rest[:n + 1]].sum(axis=0).max() <= bound <= sum(shard.tops[t] for t in rest[:n + 1])
        looked_at, opened_some = looked_at + covered.sum(), opened_some + bool(opened)
        shard.pair_at = {}
        essential, *_ = ranked.split(shard, terms, least)
        alone += (impacts[essential] > 0).any(axis=0).sum()
        for k in (1, 5):
            places, scores = ranked.search(shard, terms, 1, k)
            top = np.lexsort((places, -scores))[:k]
            want = np.lexsort((np.arange(shard.n), -totals))[:k]
            assert places[top].tolist() == want.tolist() and scores[top].tolist() == totals[want].tolist()
    assert looked_at < alone and opened_some


# --- nearest vectors ---------------------------------------------------------------------

def brute(rows, queries, k):
    width = max(len(v) for _, v in rows)
    padded = [(i, np.array(list(v) + [0.0] * (width - len(v)))) for i, v in rows]
    out = {}
    for q, v in queries:
        v = np.array(list(v) + [0.0] * (width - len(v)))
        found = sorted({(-float(np.einsum("ij,j->i", w[None], v)[0]), i) for i, w in padded if i != q})
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def frame_of(spark, rows):
    return spark.createDataFrame([(i, v, 0.5, "r") for i, v in rows], "vec_id long, embedding array<double>, score double, rank string")


def found_of(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return dict(out)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [2.0]), (9, [0.5, 0.5]), (9, [0.5, 0.5]), (None, [9.0, 9.0]), (20, [-1.0, -3.0, 2.0]), (40, [0.0, 0.0])]
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    df = frame_of(spark, rows)
    got = found_of(multiindex.nearest(df, df.where("vec_id % 20 = 0"), k=20))
    assert got == brute(sound, [(0, [1.0, 0.0]), (20, [-1.0, -3.0, 2.0])], 20)
    assert multiindex.nearest(df.limit(0), df.limit(0)).collect() == []
    assert multiindex.nearest(df, df.where("vec_id = 4")).collect() == []


@pytest.mark.parametrize("shard", [8 << 20, 1 << 14])
def test_recall_and_order(spark, monkeypatch, shard):
    """Clusters, copies of one vector, ties, and lengths between 0.2 and 3; a sample of a sixth of the rows."""
    monkeypatch.setattr(multiindex, "SAMPLE_ROWS", 500)
    monkeypatch.setattr(multiindex, "SHARD_BYTES", shard)
    monkeypatch.setattr(multiindex, "BLOCK_BYTES", 8 << 10)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 24))
    vectors = centres[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 24))
    vectors *= (rng.uniform(0.2, 3, 3000) / np.linalg.norm(vectors, axis=1))[:, None]
    vectors[100:1100] = vectors[100]  # a third of all rows hold one vector
    rows = list(enumerate(vectors.tolist()))
    df, queries = frame_of(spark, rows), [r for r in rows if r[0] % 20 == 0]
    got, want = found_of(multiindex.nearest(df, df.where("vec_id % 20 = 0"), k=20)), brute(rows, queries, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    for found in got.values():
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    held = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert held >= 0.9


def test_probing_gives_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    for m in (1, 3, 8):
        codes = rng.integers(0, 256, (400, m)).astype(np.uint8)
        shard = multiindex.Shard(np.arange(400), np.zeros((400, 1)), codes)
        for radius in (0, 1, 2, 5, 11, 27, 8 * m):
            code = codes[rng.integers(400)] ^ np.uint8(1)
            apart = np.bitwise_count(codes ^ code).sum(axis=1)
            assert shard.within(code, min(radius, 8 * m)).tolist() == np.flatnonzero(apart <= radius).tolist()
