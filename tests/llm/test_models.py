"""Packing, quality, context trees, URL trees, archives and the whole pipeline."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vitaespark.llm import arrays, contexttree, neighbours, packing, queries, secrets, urltree, warc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", "  ", "a", "<|endoftext|> b", "it's\n\n  x\x1c,", "日本 é", "word " * 3000, "z" * 6000]


# ---- packing ----

def check_packing(rows, texts, capacity=1024):
    coder = Tokenizer.from_file(JSON)
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    assert set(own) == set(texts)
    for doc, text in texts.items():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        at = 0
        for k, r in enumerate(sorted(own[doc], key=lambda r: r.piece)):
            size = first if k == 0 else capacity
            assert (r.piece, r.start, r.length) == (k, at, size)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes())
            at += size
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(frame):
    rng = random.Random(0)
    texts = dict(enumerate(ODD)) | {100 + k: "ab c, " * rng.randrange(0, 900) for k in range(150)}
    for ranks, pattern in ((RANKS, public_tokenizers.PATTERN), (None, None)):
        rows = packing.pack(frame(list(texts.items())), JSON, ranks=ranks, pattern=pattern).collect()
        used = check_packing(rows, texts)
        assert used <= math.ceil(sum(r.length for r in rows) / 1024) + 2
    assert packing.pack(frame([]), JSON).count() == 0
    twice = packing.pack(frame([(1, "a b"), (1, "a b"), (None, "c")]), JSON).collect()
    assert len(twice) == 3 and {r.doc_id for r in twice} == {1, None}
    with pytest.raises(Exception, match="not the tokenizer's"):
        packing.encoder(JSON, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode("Größenwahn überall")


@pytest.mark.parametrize("demand", [
    {}, {1024: 7}, {1: 5}, {1000: 3, 24: 3}, {300: 700, 400: 700, 350: 700, 260: 700, 500: 700, 600: 700, 700: 700}, {513: 400, 511: 100}])
def test_configurations_cover_every_length(demand):
    bins = packing.plan_sequences(demand)
    placed = Counter()
    for filling, n in bins.items():
        assert sum(filling) <= 1024 and n > 0
        for length in filling:
            placed[length] += n
    assert placed == Counter(demand)
    plain = sum(packing.best_fit(Counter(demand), Counter(), 1024).values())
    assert sum(bins.values()) <= plain


def test_knapsack_prices_the_best_filling():
    value, lengths = np.array([3.0, 4.5, 7.1]), np.array([2, 3, 5])
    for room in range(1, 14):
        best = max(a * 3 + b * 4.5 + c * 7.1 for a in range(7) for b in range(5) for c in range(3) if 2 * a + 3 * b + 5 * c <= room)
        picked = packing.best_filling(value, lengths, room)
        assert math.isclose(sum(value[lengths.tolist().index(k)] * n for k, n in picked.items()), best)


# ---- quality ----

def test_neighbours_learn_junk(frame, spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("lor", "em", "dol", "sit", "am") for b in ("a", "et", "um", "or")]

    def good():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(20, 90))).capitalize() + "."

    def junk():
        return rng.choice([lambda: good().upper().replace(" ", "!! "), lambda: " ".join([rng.choice(words)] * 40), lambda: good().replace(" ", "### ")])()

    rows = [(k, junk() if k % 4 == 0 else good()) for k in range(400)]
    docs = frame(rows + [(1000 + k, t) for k, t in enumerate(ODD)])
    labels = spark.createDataFrame(
        [(k, 0 if k % 4 == 0 else 1, 0) for k in range(400) if k % 5] + [(3, None, 0), (None, 1, 0), (7, 1, 0), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    space = neighbours.fit(docs, labels, per_class=90)
    assert space.vectors.shape[0] <= 180
    scored = {r.doc_id: r.score for r in neighbours.score(docs, space).select("row.doc_id", "score").collect()}
    assert len(scored) == 400 + len(ODD) and all(0 <= s <= 1 for s in scored.values())
    held = [k for k in range(400) if k % 5 == 0]
    assert np.mean([(scored[k] >= 0.3) == (k % 4 != 0) for k in held]) > 0.95
    # exact products, whatever the block
    counts = np.stack([neighbours.term_counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for _, t in rows[:9]])
    assert np.allclose(space.score(counts), np.concatenate([space.score(counts[k:k + 2]) for k in range(0, 9, 2)]), atol=1e-5)
    assert np.allclose(space.score(counts), [scored[k] for k in range(9)], atol=1e-5)
    assert neighbours.fit(docs, labels.limit(0)) is None
    assert {r.score for r in neighbours.score(docs, None).collect()} == {0.5}
    assert neighbours.score(docs.limit(0), space).count() == 0
    one = neighbours.fit(docs, labels.where("quality = 1"))
    assert min(r.score for r in neighbours.score(docs, one).collect()) > 0.99


def test_quality_on_held_out_documents(spark):
    rows = queries.QUERIES["op4_quality"](spark, "/root/testdata/sf0.01")
    rows = rows.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


# ---- context trees ----

def brute_tree(codes, depth):
    counts, below = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(byte):
        return [((1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1) for i in range(8)]

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    for code in codes:
        context = (code >> 8).to_bytes(depth, "big")
        for node, way in bits(code & 255):
            for d in range(depth + 1):
                counts[context[depth - d:], node][way] += 1
                if d:
                    below[context[depth - d + 1:], node].add(context[depth - d:])

    def weighted(s, node):
        own = kt(*counts[s, node])
        return own if len(s) == depth else math.log(.5) + np.logaddexp(own, sum(weighted(c, node) for c in below[s, node]))

    def mixed(context, node, way, d=0):
        s = context[depth - d:]
        a, b = counts[s, node] if (s, node) in counts else (0, 0)
        here = ((a, b)[way] + .5) / (a + b + 1)
        if d == depth or (context[depth - d - 1:], node) not in counts:
            return here
        stop = math.exp(math.log(.5) + kt(a, b) - weighted(s, node))
        return stop * here + (1 - stop) * mixed(context, node, way, d + 1)

    return lambda code: sum(math.log10(mixed((code >> 8).to_bytes(depth, "big"), node, way)) for node, way in bits(code & 255))


def test_context_tree_is_brute_force(frame, monkeypatch):
    monkeypatch.setattr(contexttree, "CHUNK_CHARS", 500)
    rng = random.Random(8)
    docs = [(k, "".join(rng.choice("aab c") for _ in range(rng.randrange(60)))) for k in range(14)] + [(50 + k, t) for k, t in enumerate([None, "", " \n", "Ab\tZZ", "aé b", "aé b"])]
    rows = contexttree.score(frame(docs), F.col("doc_id") % 5 == 0).collect()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    words = {d: re.findall("[^\x20\x09-\x0D]+", (t or "").translate(lower)) for d, t in docs}

    def codes(own):
        data = b"\n" * contexttree.DEPTH + b"".join(w.encode() + b" " for w in own) + b"\n"
        return [int.from_bytes(data[i:i + contexttree.DEPTH + 1], "big") for i in range(len(data) - contexttree.DEPTH)]

    learned = [d for d in words if d % 5]
    tokens = Counter(t for d in learned for t in [*words[d], "\n"])
    total, model = sum(tokens.values()), brute_tree([c for d in learned for c in codes(words[d])], contexttree.DEPTH)
    assert len(rows) == len(docs)
    for r in rows:
        own = [*words[r.doc_id], "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id % 5 == 0, len(own), sum(t in tokens for t in own), total)
        assert math.isclose(r.base_score, sum(math.log10((tokens[t] + 1) / (total + len(tokens) + 1)) for t in own), rel_tol=1e-9)
        want = sum(map(model, codes(words[r.doc_id])))
        assert abs(r.score - want) < 2e-4 * len(codes(words[r.doc_id])), r
    assert contexttree.score(frame([]), F.lit(False)).count() == 0
    unlearned = contexttree.score(frame([(1, "ab c"), (None, None)]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.bits_per_byte, 8, rel_tol=1e-3) for r in unlearned)


# ---- URLs ----

def test_url_rules_and_parts(spark):
    urls = ["http://A.Example.com/en/1?x#y", "https://www.example.com/en/2", "ftp://com", "x://net/es/", "http://notcom/en/", "//a/b", None, "", "a://b?c/d", "http://é.NET/fr/é#", "http://sub.net/fr", "http://u@com/x://y/en/"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)] + [(0, urls[0], 1)], "page_id long, url string, good int")
    rows = urltree.judge(pages, queries.RULES).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(rule), rule, verdict) for verdict, rule in queries.RULES
                if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/"):])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "allow")
    assert urltree.judge(pages.limit(0), queries.RULES).count() == 0


def test_url_tree_rejects_bad_branches(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        part = rng.choice(["news", "news", "spam", "shop", "shop"])
        good = None if rng.random() < .5 else int(rng.random() < (.1 if part == "spam" else .9))
        rows.append((k, f"http://h.org/{part}/{rng.randrange(10 ** 6)}" + rng.choice(["", ".html", "/x/y/z"]), good))
    rows += [(1000 + k, f"http://tiny.org/{k}", 0 if k == 0 else None) for k in range(3)]
    got = {r.page_id: r for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string, good int"), []).collect()}
    assert len(got) == len(rows)
    for k, url, _ in rows:
        if "h.org" in url:
            part, *rest = url.split("/")[3:]
            assert got[k].template.startswith(f"/{part}/*") and got[k].template.count("/") == min(2 + len(rest) - 1, 4)
            assert got[k].verdict == ("block" if part == "spam" else "allow"), got[k]
        else:
            assert got[k].template == "/*" and got[k].verdict == "allow"  # one bad label of three is too little


def test_similar_siblings_are_merged(spark):
    pages = spark.createDataFrame(
        [("h", f"/{p}/*", g) for p, share in (("a", 8), ("b", 7), ("c", 0)) for g in [1] * share * 5 + [0] * (10 - share) * 5], "host string, template string, good int")
    rows = {r.template: r for r in urltree.judged_templates(pages).collect()}
    assert rows["/a/*"].branch == rows["/b/*"].branch != rows["/c/*"].branch
    assert [rows[f"/{p}/*"].verdict for p in "abc"] == ["allow", "allow", "block"]


# ---- archives ----

def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "PART_LINES", 10)
    rng = random.Random(7)
    bodies = ["<p>é</p>", "", None, "x\r\n\r\ny" * 50, "日本"] + ["<b>" + "ab" * rng.randrange(400) for _ in range(20)]
    rows = [(k, rng.choice([None, "", f"http://H{k % 7}.com/p/{k}?q", f"http://same.org/{k % 3}"]), rng.choice(bodies)) for k in range(90)]
    rows += [(3, rows[3][1], rows[3][2]), (4, rows[4][1], "another"), (None, "http://n.org", "<p>é</p>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(5)
    got = Counter((r.page_id, r.bytes, r.digest, r.type, r.refers_to) for r in warc.round_trip(pages).collect())
    firsts = {}
    for k, _, html in rows:
        if k is not None:
            firsts[html or ""] = min(k, firsts.get(html or "", k))
    want = Counter()
    for k, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = firsts.get(html or "")
        want[k, len(data), digest, "response" if k == first else "revisit", None if k == first else first] += 1
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_smaller_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(k, "http://a.b/c", "tiny" if k % 2 else "long enough") for k in range(6)], "page_id long, url string, html string")
    rows = warc.round_trip(pages, least_bytes=5).collect()
    assert {r.page_id for r in rows if r.type == "revisit"} == {2, 4}


def test_unknown_keys_are_not_found(spark):
    pages = spark.createDataFrame([(k, f"http://a{k}.b/c", "x") for k in range(30)], "page_id long, url string, html string")
    archive, index = warc.shared_folder(spark, "archive"), warc.shared_folder(spark, "index")
    lines = warc.written(warc.write_archives(pages, archive), "lines")
    parts = warc.write_index(lines, index)
    asked = lines.select("key", "page_id", "digest").union(spark.createDataFrame([("b,a5)/zz", 5, "d"), ("", 0, ""), ("zz", 1, "")], "key string, page_id long, digest string"))
    rows = warc.lookup(asked, parts, archive, index).collect()
    assert sum(r.found for r in rows) == 30 and len(rows) == 33


# ---- pipeline ----

def test_pipeline_is_its_parts(spark, frame, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("lor", "em", "dol", "sit", "am", "ke") for b in ("a", "et", "um", "or", "is")]

    def prose(n=60):
        return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."

    leak = prose(25)
    docs = [(k, prose()) for k in range(60)] + [(100 + k, prose().upper().replace(" ", "!! ")) for k in range(30)]
    docs += [(200, docs[5][1]), (201, docs[6][1] + " more"), (202, prose(30) + " " + leak + " " + prose(30)), (203, leak),
             (204, prose() + " password=abcdef123456 " + prose()), (205, None), (206, ""), (None, prose()), (None, prose()), (7, docs[7][1])]
    frame(docs).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0 if 100 <= k < 130 else 1, 0) for k, _ in docs if k is not None and k < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.written(stage(spark, table, str(tmp_path)), "stage")
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        texts.append([(r.doc_id, r.text) for r in table.collect()])
    good = [(d, t) for d, t in docs if d is None or not 100 <= d < 130]
    key = lambda row: (row[0] is None, row[0] or 0, row[1] or "")
    assert sorted(texts[0], key=key) == sorted(good, key=key)
    unique = [row for k, row in enumerate(good) if row[0] not in (200, 201) and row not in good[:k]]
    assert sorted(texts[1], key=key) == sorted(unique, key=key)
    cut = [(d, t.replace(leak[:-1], "") if t else t) for d, t in unique if d != 203]
    assert sorted(texts[2], key=key) == sorted(cut, key=key)
    hidden = [(d, t.replace("password=abcdef123456", "[REDACTED]") if t else t) for d, t in cut]
    assert sorted(texts[3], key=key) == sorted(hidden, key=key)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    assert sorted({r.doc_id for r in rows if r.doc_id is not None}) == sorted(d for d, _ in hidden if d is not None)
    assert sum(r.doc_id is None and r.piece == 0 for r in rows) == 2


def test_near_dedup_tells_rows_apart(spark, frame):
    """Copies without an id go, different texts with one id stay, of equal rows one stays."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    docs = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[2] + " end"), (None, texts[3]), (None, texts[3] + " end"), (None, texts[4]),
            (None, texts[0]), (5, texts[5]), (5, texts[5]), (6, None), (7, ""), (8, "")]
    left = corpus_pipeline.near_dedup(spark, frame(docs), "")
    assert left.columns == frame(docs).columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert [g for g in got if g[0] is not None] and sorted(g for g in got if g[0] not in (None, 6)) == [
        (1, *sorted(texts[:2])[:1]), (1, *sorted(texts[:2])[1:]), (2, texts[2]), (5, texts[5]), (7, ""), (8, "")]
    assert (6, None) in got and len([g for g in got if g[0] is None]) == 2 and (None, texts[4]) in got
    assert corpus_pipeline.near_dedup(spark, frame([]), "").count() == 0


def test_a_chunk_asks_in_bounded_batches(monkeypatch):
    """Round 3, op5: a chunk's texts come batch by batch and never as one table; every key is asked for once."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc d") for _ in range(200)) for _ in range(50)]
    batch = lambda part: pa.RecordBatch.from_pydict({"text": pa.array(part, pa.string())})
    rows = lambda: pa.Table.from_batches(contexttree.chunk_keys((pa.scalar(7),), map(batch, (texts[:20], texts[20:])))).to_pylist()
    want = rows()
    monkeypatch.setattr(contexttree, "MERGE", 50)
    assert rows() == want and len({(r["kind"], r["key"]) for r in want}) == len(want) and {r["chunk"] for r in want} == {7}
    raw, offsets = arrays.utf8(pa.array(texts, pa.string()))
    code, _, hashes, _ = contexttree.stream(raw, offsets)
    assert {r["key"] for r in want if r["kind"] == contexttree.GRAM} == set(code.tolist())
    assert {r["key"] for r in want if r["kind"] == contexttree.TOKEN} == {*hashes.tolist(), contexttree.END_KEY}
    key, n = contexttree.counted([code, code[:5]], [np.ones(len(code), np.int64), np.full(5, 3)])
    assert dict(zip(key.tolist(), n.tolist())) == Counter(code.tolist()) + Counter({k: 3 * v for k, v in Counter(code[:5].tolist()).items()})
