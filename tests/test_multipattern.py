"""Patterns of all postings in all texts at once, against looking for each one."""

import random

import pytest
from pyspark.sql import functions as F

from vitaespark.operators import matching, multipattern
from vitaespark.workload import derive

FOLDER = "/root/testdata/sf0.001"


def plain(texts, patterns):
    return None if texts is None else [None if t is None else sorted(p for p in patterns if p in t) for t in texts]


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_held_and_counted_equal_plain_search(spark, block_bytes):
    rng = random.Random(5)
    patterns = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["aa", "a", "aba", "", None, "c++", "日本", "aa"]
    texts = [["".join(rng.choice("abé c+") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(0, 4))] for _ in range(80)]
    texts += [None, [], [None], ["aaaa", None, "c++ 日本語"], ["ab" * 30_000]]
    blocks = multipattern.Patterns(spark.createDataFrame([(p,) for p in patterns], "p string"), block_bytes)
    assert (len(blocks.blocks) > 1) == (block_bytes == 40)
    assert len({p for b in blocks.blocks for p in b.value}) == sum(len(b.value) for b in blocks.blocks)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, texts array<string>")
    known = {p for p in patterns if p}
    got = {r.id: r.hits for r in df.select("id", blocks.held(F.col("texts")).alias("hits")).collect()}
    words = spark.createDataFrame([(["AA", "", None, "nowhere", *sorted(known)],)], "w array<string>").select(blocks.coded(F.col("w")).alias("w")).first().w
    assert [w.code for w in words[1:4]] == ["", None, None] and len({w.code for w in words[4:]}) == len(known)
    code = {w.name: w.code for w in words}
    assert code["AA"] == code["aa"]
    for i, t in enumerate(texts):
        hits = got[i] if got[i] is None else [None if h is None else sorted(p for p in known if code[p] in h) for h in got[i]]
        assert hits == plain(t, known)
    lines = df.select("id", F.explode_outer("texts").alias("text")).where("id <> 84")
    table = multipattern.hit_table(lines.withColumn("line", F.monotonically_increasing_id()), ["line", "text"], "text", blocks).collect()
    assert {(r.text, r.pattern): r.n for r in table} == {(t, p): t.count(p) for ts in texts[:-1] for t in ts or () if t for p in known if p in t}


def test_no_patterns(spark):
    none = multipattern.Patterns(spark.createDataFrame([("",), (None,)], "p string"))
    row = spark.createDataFrame([(["a", None], None)], "a array<string>, b array<string>").select(
        none.held(F.col("a")).alias("a"), none.held(F.col("b")).alias("b"), none.counted(F.col("a")[0]).alias("c"),
        none.coded(F.array(F.lit("x"), F.lit(""))).code.alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (["", None], None, [], [None, ""])


def test_a_pair_reads_no_text(spark):
    """Texts are searched below the join, once per résumé; what is joined with a pair holds hits only."""
    pairs, postings, people = (f(spark, FOLDER) for f in (derive.applications, derive.postings, derive.resumes))
    paired = matching.pair_records(pairs, postings, people)
    for df in (matching.gaps(paired), matching.tailor(paired).select("jd_id", "experience.company", "jd_gap")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Join") < plan.index("ArrowEvalPython")
        joined = plan[:plan.index("Join")]
        assert not any(text in joined for text in ("history_text", "whole_text", "job_texts", "project_texts", "duty_texts"))
    # a word of a posting that no other posting has is found in its candidates' texts as well as any other
    odd = postings.withColumn("soft_skills", F.concat("soft_skills", F.array(F.concat(F.lit("nowhere-"), "jd_id"), F.lit(""), F.lit(None).cast("string"))))
    gaps = matching.gaps(matching.pair_records(pairs, odd, people)).where("category = 'soft_skill_gap'")
    assert gaps.where("keyword LIKE 'nowhere-%'").count() == pairs.count()
    assert gaps.where("keyword = '' OR keyword IS NULL").count() == 0
