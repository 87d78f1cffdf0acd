"""Decontamination, secrets, shared passages, near-duplicates and fingerprints on small texts."""

import hashlib
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitaespark.llm import arrays, chunks, decontaminate, fmindex, nearjoin, orderhash, secrets

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")
ODD = [None, "", "   \n", "a", "A a A a", "é\x1cÜ x", "x" * 5000, "Ab " * 3000, "日本 語 ab", "tab\tcr\r\nend\x0b."]


def text_of(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def test_hashing_and_shards_take_little_memory():
    text = " ".join(f"word{k}" for k in range(100_000)).encode()
    data = np.frombuffer(text, np.uint8)
    begin, end, _ = arrays.words(data, np.array([0, len(data)]), arrays.ALNUM)
    tracemalloc.start()
    arrays.word_hashes(data, begin, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 26 * len(data) and decontaminate.SHARD_BYTES <= 1_000_000


def test_words_and_hashes():
    raw, offsets = arrays.utf8(pa.array(ODD, pa.string()))
    data = arrays.LOWER[raw]
    for member, pattern in ((arrays.SPACED, SPACED), (arrays.ALNUM, ALNUM)):
        begin, end, first = arrays.words(data, offsets, member)
        hashes, seen = arrays.word_hashes(data, begin, end), {}
        for k, text in enumerate(ODD):
            want = [w.encode() for w in pattern.findall((text or "").translate(LOWER))]
            got = [bytes(data[b:e]) for b, e in zip(begin[first[k]:first[k + 1]], end[first[k]:first[k + 1]])]
            assert got == want
            for word, h in zip(want, hashes[first[k]:first[k + 1]].tolist()):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(3)
    for n, symbols in ((1, 1), (60, 2), (800, 5), (3000, 90)):
        text = np.concatenate([rng.integers(1, symbols + 1, n), [0]])
        index = fmindex.FMIndex(text)
        assert fmindex.suffix_array(text, int(text.max()).bit_length()).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert sorted(index.locate(np.arange(n + 1)).tolist()) == list(range(n + 1))
        for size in (1, min(3, n)):
            patterns = np.unique(np.array([text[i:i + size] for i in rng.integers(0, n - size + 1, 20)]), axis=0)
            low, high = index.search(patterns)
            for p, a, b in zip(patterns, low, high):
                want = [i for i in range(n - size + 1) if (text[i:i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    low, high = index.search(np.array([[symbols + 0, 1, 1, 1, 1, 1]]))
    assert high[0] - low[0] == sum((text[i:i + 6] == [symbols, 1, 1, 1, 1, 1]).all() for i in range(n - 5))


@pytest.fixture
def leaks(frame, spark):
    rng = random.Random(1)
    items = [(k, text_of(rng, rng.choice([1, 4, 9, 10, 11, 30]))) for k in range(12)] + [(12, None), (13, " . "), (None, "w1 w2"), (3, text_of(rng, 15))]
    docs = [(k, text_of(rng, 60) + " " + (rng.choice(items)[1] or "") + ". " + text_of(rng, 20)) for k in range(40)]
    docs += [(100 + k, t) for k, t in enumerate(ODD)] + [(0, docs[0][1]), (200, items[5][1]), (201, items[5][1] + " " + items[5][1])]
    return frame(docs), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_decontamination_is_brute_force(leaks, monkeypatch):
    docs, benchmark, rows, items = leaks

    def words(t):
        return ALNUM.findall((t or "").translate(LOWER))

    owners = {}
    for item, text in items:
        own = words(text)
        for at in range(max(1, len(own) - 9) if own and item is not None else 0):
            owners.setdefault(tuple(own[at:at + 10]), set()).add(item)
    want = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for key, ids in owners.items():
            for at in range(len(own) - len(key) + 1):
                if tuple(own[at:at + len(key)]) == key:
                    hit.update(range(at, at + len(key)))
                    found |= ids
        want.append((doc, len(own), len(hit), sorted(found)))
    for bound in (decontaminate.BLOCK_BYTES, 300):  # in one pass, and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", bound)
        got = decontaminate.scan(docs, benchmark).select("row.doc_id", "n_words", "hits", "items").collect()
        got = [(r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), sorted(r["items"])) for r in got]
        assert sorted(got) == sorted(want)
    cleaned = decontaminate.clean(docs, benchmark)
    assert cleaned.columns == docs.columns
    kept = {r.doc_id: r for r in cleaned.collect()}
    for doc, n, hit, _ in want:
        if hit and hit == n:
            assert doc not in kept
        else:
            text = kept[doc].text
            assert (text == dict(rows)[doc]) == (hit == 0)
            assert hit == 0 or kept[doc].n_chars == len(text) and len(words(text)) == n - hit
    assert decontaminate.scan(docs.limit(0), benchmark).count() == 0
    assert decontaminate.scan(docs, benchmark.limit(0)).where("size(hits) > 0").count() == 0


def test_secrets(frame):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ODD + [
        'x Token = "abcdef12", PASSWORD:short apiKey=123456 api_key=12345', "AKIA" + "A" * 16 + " AKIASHORT xAKIA" + "1" * 20,
        "0" * 24 + "z" + "f" * 23, "key 8fJq2LxV9tRz0WmKp4Yd7NsB end", "id 550e8400-e29b-41d4-a716-446655440000",
        "sha " + "ab12" * 10, "see user_profile_settings_page_2 and a-b-c-d-e-f-g-h-i-j-k-l", "é token: secret=aaaaaa", "secret='ſecret:abcdefg"]
    rows = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.find(frame(list(enumerate(texts))), path, pattern).collect()}
    for k, text in enumerate(texts):
        text = text or ""
        want = [("assign", *m.span()) for m in re.finditer(
            r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert sorted(s for s in rows[k] if s[0] != "random") == sorted(want)
        assert rows[k] == sorted(rows[k], key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    random_ones = {k for k in rows if any(s[0] == "random" for s in rows[k])}
    n = len(ODD)
    assert n + 3 in random_ones and not random_ones & {n + 4, n + 5, n + 6}
    cut = {r.doc_id: r for r in secrets.redact(frame(list(enumerate(texts))), path, pattern).collect()}
    assert cut[0].text is None and cut[3].text == "a" and cut[n + 3].text == "key [REDACTED] end" and cut[n + 3].n_chars == 18
    assert secrets.find(frame([]), path, pattern).count() == 0


@pytest.mark.parametrize("letters, size, share", [
    ("abcdefghijklmnopqrstuvwxyz", 20, 0.85), ("abcdefghijklmnopqrstuvwxyz", 32, 0.93), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 20, 0.95),
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 16, 0.97), ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 40, 0.99),
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16, 0.97), ("0123456789ABCDEF", 32, 0.9), ("0123456789ABCDEF", 40, 0.9),
    ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 20, 0.97)])
def test_random_strings_of_any_kind(letters, size, share):
    """Strings without digits, short ones and upper-case hexadecimal are found by their ratio, too."""
    coding = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(6)
    keys = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(500)]
    assert sum(secrets.random_spans(f"key {k} end", coding) == [("random", 4, 4 + size)] for k in keys) >= share * 500
    for known in ("see a-b-c-d-e-f-g-h-i-j-k-l", "getUserProfileSettings2", "user_profile_settings_page_12", "2024-01-02/2024-03-04/17",
                  "20240102T101500Z", "ab12" * 10, "550E8400-E29B-41D4-A716-446655440000", "=" * 40, "einpfauaueinchpf", "SCHCHSTSCHUNGAUPF"):
        assert not secrets.random_spans(known, coding), known


def test_shared_passages(frame):
    rng = random.Random(5)
    passage = text_of(rng, 70, 10 ** 6)
    docs = [(k, text_of(rng, 100, 10 ** 6)) for k in range(30)]
    docs += [(100 + k, text_of(rng, rng.randrange(1, 50), 10 ** 6) + " " + passage + " " + text_of(rng, 30, 10 ** 6)) for k in range(6)]
    docs += [(200, passage + " " + passage), (300, docs[0][1]), (400, text_of(rng, 100, 10 ** 6) * 2)] + [(500 + k, t) for k, t in enumerate(ODD)]
    found = chunks.repeats(frame(docs)).collect()
    assert {r.doc_id for r in found} == {0, 300, 200, *range(100, 106)}
    for r in found:
        text = dict(docs)[r.doc_id]
        assert text[r.start:r.end] in (passage + " " + passage if r.doc_id >= 100 and r.doc_id != 300 else docs[0][1])
        assert r.n_words >= chunks.LEAST_WORDS and r.first_doc_id <= r.doc_id
    assert chunks.repeats(frame([])).count() == 0
    whole = chunks.chunk(frame(docs)).collect()
    for doc, text in docs:
        own = sorted((r.start, r.end) for r in whole if r.doc_id == doc)
        assert "".join((text or "")[a:b] for a, b in own) == (text or "")


def brute_passages(docs):
    """Every passage by its runs of 50 words, looked up one by one."""
    own = {n: [m.span() for m in SPACED.finditer(t)] for n, (_, t) in enumerate(docs)}
    runs = {}
    for n, (doc, t) in enumerate(docs):
        for i in range(len(own[n]) - 49):
            runs.setdefault(tuple(t[a:b] for a, b in own[n][i:i + 50]), []).append((n, i))
    covered = {}
    for places in runs.values():
        if len({docs[n][0] for n, _ in places}) > 1:
            for n, i in places:
                covered.setdefault(n, set()).update(range(i, i + 50))
    want = set()
    for n, at in covered.items():
        for a in sorted(x for x in at if x - 1 not in at):
            b = next(x for x in range(a, len(own[n]) + 1) if x not in at)
            want.add((docs[n][0], own[n][a][0], own[n][b - 1][1], b - a))
    return want


def test_shared_passages_are_brute_force(frame):
    """Runs of 50 to 60 words at many places, of short words and of few, and passages of which the first copy has a part."""
    rng = random.Random(11)
    docs = [(k, text_of(rng, rng.randrange(1, 90), 10 ** 6)) for k in range(20)]
    for k in range(150):
        size, vocabulary = rng.choice([48, 49, 50, 51, 52, 55, 60]), rng.choice([2, 3, 400, 10 ** 6])
        passage = text_of(rng, size, vocabulary) if k % 3 else " ".join(rng.choice("abc") for _ in range(size))
        docs += [(100 + 2 * k + i, " \n".join([text_of(rng, rng.randrange(1, 40), 10 ** 6), passage, text_of(rng, rng.randrange(1, 40), 10 ** 6)])) for i in (0, 1)]
    long = text_of(rng, 80, 10 ** 6).split()
    docs += [(50 + i, " ".join(long[a:b] + [f"z{i}"] * i)) for i, (a, b) in enumerate([(20, 50), (0, 70), (10, 80)])]
    docs += [(60 + i, " ".join(["p", "q", "r"] * n)[2 * i:] + f" é{i}") for i, n in enumerate([30, 40, 50])]
    docs += [(70, f"{docs[0][1]} {docs[1][1]}"), (70, text_of(rng, 60)), (None, docs[3][1]), (None, docs[3][1])]
    want = brute_passages(docs)
    got = [(r.doc_id, r.start, r.end, r.n_words) for r in chunks.repeats(frame(docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


def test_edited_copies_are_brute_force(frame):
    """Groups of copies with words changed, put in and left out here and there, and parts of them in other texts."""
    rng = random.Random(19)
    docs = []
    for group in range(8):
        words = text_of(rng, rng.choice([60, 120, 300]), rng.choice([5, 50, 10 ** 6])).split()
        for k in range(9):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 3])):
                at = rng.randrange(len(own))
                own[at:at + rng.randrange(2)] = [f"e{rng.randrange(4)}"] * rng.randrange(2)
            if k > 6:
                at = rng.randrange(len(own) - 50)
                own = text_of(rng, 20, 10 ** 6).split() + own[at:at + rng.randrange(48, 80)] + text_of(rng, 20, 10 ** 6).split()
            docs.append((100 * group + rng.choice([k, k, 0]), " ".join(own)))
    got = [(r.doc_id, r.start, r.end, r.n_words) for r in chunks.repeats(frame(docs)).collect()]
    assert set(got) == brute_passages(docs) and len(set(got)) > 60


def test_gear_cuts_move_only_near_an_insertion():
    """The rolling value is the plain recursion's, chunks are short, and a word put in changes a few cuts around it."""
    rng = random.Random(7)
    norm = np.frombuffer(text_of(rng, 80).encode(), np.uint8)
    h, want = 0, []
    for byte in norm.tolist():
        h = (2 * h + int(chunks.GEAR[byte])) % (1 << 16)
        want.append(h)
    assert chunks.gear(norm).tolist() == want
    span = chunks.span_of(chunks.LEAST_WORDS)
    for vocabulary in (3, 10 ** 6):
        text = text_of(rng, 3000, vocabulary).split()
        at = rng.randrange(500, 2500)

        def cuts(own):
            raw, offsets = arrays.utf8(pa.array([" ".join(own)]))
            return chunks.Words(raw, offsets, chunks.LEAST_WORDS).cuts

        before, after = cuts(text), cuts(text[:at] + ["new"] + text[at:])
        assert max(np.diff(before)) <= span
        assert set(before[before < at - span]) == set(after[after < at - span])
        reach = at + span + chunks.REACH
        assert set(before[before >= reach]) == set(after[after >= reach + 1] - 1)


def brute_components(docs, size, percent):
    sets = {}
    for doc, text in docs:
        own = SPACED.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(own[i:i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates_are_brute_force(frame, monkeypatch, block):
    """Chains of edited copies around the threshold, a common passage, exact copies, odd texts."""
    monkeypatch.setattr(nearjoin, "BLOCK", block)
    rng = random.Random(9)
    docs, k = [], 0
    common = text_of(rng, 30)
    for _ in range(6):
        base = (text_of(rng, rng.randrange(20, 120)) + " " + common).split()
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(1000)}"
            docs.append((k, " ".join(own)))
            k += 1
            if rng.random() < 0.2:
                base = own
    docs += [(500 + i, docs[i][1].upper()) for i in range(5)] + [(600 + i, t) for i, t in enumerate(ODD)] + [(700, "A a  a A")]
    got = {r.doc_id: r for r in nearjoin.near_duplicates(frame(docs), size=4).collect()}
    want = brute_components(docs, 4, 80)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_copies_do_not_meet_all_hubs(frame, monkeypatch):
    """Round 3, the pipeline's near-dedup: a group of near copies is joined by a few pairs a document, not by all hubs."""
    rng = random.Random(5)
    base, docs = text_of(rng, 200).split(), []
    for k in range(80):
        own = list(base)
        own[rng.randrange(len(own))] = f"e{rng.randrange(1000)}"
        docs.append((k, " ".join(own)))
    met, joined = [], nearjoin.joined

    def counted(pairs, table, column):
        met.append(pairs.count())
        return joined(pairs, table, column)

    monkeypatch.setattr(nearjoin, "joined", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nearjoin.near_duplicates(frame(docs), size=4).collect()}
    assert got == brute_components(docs, 4, 80)
    assert max(met) <= 2 * len(docs)


def test_near_duplicates_odd_rows(frame):
    assert nearjoin.near_duplicates(frame([])).count() == 0
    text, other = "a b c d e f g", "p q r s t u v"
    rows = nearjoin.near_duplicates(frame([(1, text), (1, text), (None, "x y z z z z"), (5, other), (1, other), (9, text)])).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows) == [
        ("1", 1, True), ("1", 1, True), ("1", 1, True), ("5", 1, False), ("9", 1, False), ("None", None, True)]
    alone = nearjoin.near_duplicates(frame([(3, None), (4, None), (5, "")])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in alone) == [(3, 0, 3), (4, 0, 4), (5, 0, 5)]


def test_order_minhash(frame):
    rng = random.Random(2)
    docs = [(k, text_of(rng, 200)) for k in range(20)] + [(30 + k, t) for k, t in enumerate(ODD)] + [(60, docs_text := text_of(rng, 90)), (61, docs_text)]
    rows = {r.doc_id: r for r in orderhash.edited_fingerprints(frame(docs)).collect()}
    texts = {d: t or "" for d, t in docs}
    ids = sorted(texts, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1]))
    for d in ids:
        third = len(texts[d]) // 3
        edited = texts[d][:len(texts[d]) - third] + texts[following[d]][:third]
        assert (rows[d].n_chars, rows[d].edited_sha256) == (len(texts[d]), hashlib.sha256(edited.encode()).hexdigest())
        assert len(rows[d].fingerprint) == 8 * orderhash.TUPLES
    assert rows[60].fingerprint == rows[61].fingerprint and rows[61].near_next == 1 and rows[30].fingerprint == rows[31].fingerprint
    assert np.mean([rows[d].near_edited for d in range(20)]) > 0.1 > np.mean([rows[d].near_next for d in range(20)])
    assert orderhash.edited_fingerprints(frame([])).count() == 0
    again = orderhash.edited_fingerprints(frame([(1, "a b c"), (1, "a b c"), (None, "x y")])).collect()
    assert len(again) == 3 and {r.doc_id for r in again} == {1, None}


def test_order_minhash_follows_order_and_occurrences(spark):
    """The same k-mers in another order, and the same set with other multiplicities, are told apart."""
    rng = random.Random(4)
    a, b = text_of(rng, 300, 10 ** 5), text_of(rng, 300, 10 ** 5)
    texts = spark.createDataFrame([(0, f"{a} {b}"), (1, f"{b} {a}"), (2, f"{a} {b}"), (3, " ".join(["p q r"] * 50)), (4, " ".join(["p q r"] * 5))], "k long, text string")
    prints = {r.k: r.fingerprint for r in orderhash.fingerprints(texts, ["k"]).collect()}
    pairs = spark.createDataFrame([(prints[0], prints[1]), (prints[0], prints[2]), (prints[3], prints[4])], "a string, b string")
    swapped, same, repeated = [r[0] for r in pairs.select(orderhash.likeness(F.col("a"), F.col("b"))).collect()]
    assert same == 1 and 0.2 < swapped < 0.8 and repeated < 0.3


def test_order_minhash_holds_no_row_per_kmer(spark):
    """Hash aggregates only: nothing is sorted by k-mer, and repeated k-mers are numbered without a look at each."""
    texts = spark.createDataFrame([(0, "p q r " * 4000), (1, "a b"), (2, None), (None, "p q r s")], "k long, text string")
    prints = orderhash.fingerprints(texts, ["k"])
    plan = prints._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "array_position" not in plan
    assert {r.k for r in prints.collect()} == {0, 1, 2, None}
    elements = orderhash._elements(texts.where("k = 0"), ["k"]).select("x").collect()
    assert len({r.x & ~orderhash.PLACE for r in elements}) == len(elements) == 11998
