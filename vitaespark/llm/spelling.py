"""Spelling variants: words one edit apart, found by walking a trie level by level.

The trie is a table: one row per node (a prefix) with the letters that go on from it and whether it is a
word itself.  The frontier is a table of states (word, position, node, edits): what is left of a word
once it has been followed, with at most one letter replaced or left out, to a node.  Each level joins
the frontier with the nodes of its depth; a state with one edit that ends at a word is a pair.

An edit in the second half of a word is looked for in the trie of words, one in the first half in the
trie of words read backwards: a word enters the frontier at the depth of its half, where nodes have few
letters and no node holds a large part of all words.  Every pair has one place: an inserted letter is
the deletion read from the longer word, a replaced one is found from the smaller letter, and of equal
letters in a row the last is the one left out.  So no pair is made twice and none needs removing.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaespark.llm.arrays import text_column, written
from vitaespark.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[A-Za-z\\u00C0-\\u00FF]"

#: Longest word that walks the trie (a job per level); pairs with a longer one meet at deletion keys.
DEEPEST = 48


def occurrences(docs: DataFrame, least_chars: int, every: int) -> DataFrame:
    """One row per occurrence: the run in lower case, one letter left out where ``every`` divides its crc32.

    Runs of fewer than ``least_chars`` letters are not looked at; leaving out makes no run longer.
    """
    runs = F.regexp_extract_all(text_column(), F.lit(f"({RUN}{{{least_chars},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "utf-8")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def words(docs: DataFrame, least_chars: int = 6, least_times: int = 5, every: int = 199) -> DataFrame:
    """Distinct words with the number ``n`` of their occurrences in all documents."""
    found = occurrences(docs, least_chars, every).where(F.length("word") >= least_chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_times)


def _sided(vocabulary: DataFrame) -> DataFrame:
    """Each word forwards and backwards, with the first position that this side's trie may edit."""
    half = F.floor(F.length("word") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(False).alias("back"), F.col("word").alias("key"), half.alias("half")),
        F.struct(F.lit(True).alias("back"), F.reverse("word").alias("key"), (F.length("word") - half).alias("half")))
    return vocabulary.select("word", F.inline(sides))


def nodes(sided: DataFrame) -> DataFrame:
    """(depth, back, node, letters, ends): every prefix of half a word and more.

    A walk comes to words of the same length or a letter less, whose half is not longer, so no more is needed.
    """
    steps = F.sequence("half", F.length("key"))
    each = sided.select("back", "key", F.explode(steps).alias("depth"))
    each = each.select("back", "depth", F.expr("left(key, depth)").alias("node"), F.expr("substring(key, depth + 1, 1)").alias("letter"))
    return each.groupBy("depth", "back", "node").agg(
        F.collect_set(F.nullif("letter", F.lit(""))).alias("letters"), F.bool_or(F.col("letter") == "").alias("ends"))


def _expand(back: Column, rest: Column, node: Column, edits: Column, letters: Column, ends: Column) -> Column:
    """What a state becomes at a node: states one letter further, or ``found`` words."""
    kind = "array<struct<rest: string, node: string, edits: int, found: boolean>>"
    first, second = F.substring(rest, 1, 1), F.substring(rest, 2, 1)

    def state(left, at, n, found=False):
        return F.struct(left.alias("rest"), at.alias("node"), F.lit(n).alias("edits"), F.lit(found).alias("found"))

    def onwards(by):
        return F.substring(rest, F.lit(1 + by), F.length(rest))

    none = F.expr(f"cast(array() as {kind})")
    follow = F.when(F.array_contains(letters, first), F.array(state(onwards(1), F.concat(node, first), 1))).otherwise(none)
    edited = F.when(rest == "", F.when(ends, F.array(state(rest, node, 1, True))).otherwise(none)).otherwise(follow)
    exact = F.when(F.length(rest) > 1, F.array(state(onwards(1), F.concat(node, first), 0))).otherwise(none)
    replaced = F.transform(F.filter(letters, lambda c: c > first), lambda c: state(onwards(1), F.concat(node, c), 1))
    # of equal letters in a row (as read forwards) only the last is left out
    last_of_run = F.when(back, F.right(node, F.lit(1)) != first).otherwise(first != second)
    shorter = F.when(
        last_of_run,
        F.when(second == "", F.when(ends, F.array(state(F.lit(""), node, 1, True))).otherwise(none))
        .when(F.array_contains(letters, second), F.array(state(onwards(2), F.concat(node, second), 1))).otherwise(none)).otherwise(none)
    return F.when(edits == 1, edited).otherwise(F.concat(exact, replaced, shorter))


def _trie_pairs(vocabulary: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of words of at most ``DEEPEST`` letters that are one edit apart, each once."""
    sided = written(_sided(vocabulary), "sided-words")
    reach = sided.agg(F.min("half"), F.max(F.length("key"))).first()
    if reach[0] is None:
        return None
    trie = _by_depth(nodes(sided))
    entering = sided.select(
        "back", "word", F.expr("substring(key, half + 1)").alias("rest"), F.expr("left(key, half)").alias("node"), F.lit(0).alias("edits"), F.col("half"))
    frontier, pairs = None, []
    for depth in range(reach[0], reach[1] + 1):
        states = entering.where(F.col("half") == depth).drop("half")
        if frontier is not None:
            states = states.unionByName(frontier)
        level = trie.where(F.col("depth") == depth).drop("depth")
        moved = states.join(level, ["back", "node"]).select(
            "back", "word", F.inline(_expand(*[F.col(c) for c in ("back", "rest", "node", "edits", "letters", "ends")])))
        moved = written(moved, "frontier")
        frontier = moved.where("not found").drop("found")
        pairs.append(moved.where("found").select(F.col("word").alias("a"), F.when(F.col("back"), F.reverse("node")).otherwise(F.col("node")).alias("b")))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out


def _by_depth(trie: DataFrame) -> DataFrame:
    """The trie written with a folder per depth, so that a level reads its own nodes only."""
    path = shared_folder(trie.sparkSession, "trie")
    trie.write.partitionBy("depth").parquet(path)
    return trie.sparkSession.read.schema(trie.schema).parquet(path)


def _long_pairs(vocabulary: DataFrame) -> DataFrame:
    """Pairs (a, b) with a word of more than ``DEEPEST`` letters, each once.

    Words with one letter left out meet at (place, what is left), or at what is left with a whole word;
    a key's group holds the letters of one place, so it is bounded by the alphabet.
    """
    near = vocabulary.where(F.length("word") >= DEEPEST)
    cut = near.select("word", F.posexplode(F.expr(
        "transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substring(word, i + 1)))")).alias("at", "key"))
    cut = written(cut.select("word", "at", F.sha2("key", 256).alias("key")), "deletions")
    a, b = cut.alias("a"), cut.alias("b")
    replaced = a.join(b, ["at", "key"]).where("a.word < b.word").select(F.col("a.word").alias("a"), F.col("b.word").alias("b"))
    whole = near.select(F.col("word").alias("b"), F.sha2("word", 256).alias("key"))
    shorter = cut.join(whole, "key").select(F.col("word").alias("a"), "b").distinct()
    return replaced.unionByName(shorter).where(F.greatest(F.length("a"), F.length("b")) > DEEPEST)


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, other) for every two words of ``vocabulary.word`` one inserted, deleted or replaced letter apart, both ways."""
    pairs = _trie_pairs(vocabulary.where(F.length("word") <= DEEPEST).select("word"))
    if vocabulary.where(F.length("word") > DEEPEST).limit(1).count():
        more = _long_pairs(vocabulary.select("word"))
        pairs = more if pairs is None else pairs.unionByName(more)
    if pairs is None:
        return vocabulary.select("word", F.col("word").alias("other")).limit(0)
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"))))
    return written(pairs, "near-words").select(both)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where the forms of a word end.  Each round doubles the way gone."""
    at = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = written(at.join(jump, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        moved = at.where("moved").limit(1).count()
        at = at.select("word", "root")
        if not moved:
            return at


def variants(docs: DataFrame, least_chars: int = 6, least_times: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the documents.

    A word's form is its near word of most occurrences (of equal ones the smallest by code points) if
    these are at least ``times`` its own.  Null and empty texts have no words, a null id counts as empty
    text, repeated rows count each, further columns play no part; no documents give no rows.
    """
    vocabulary = written(words(docs, least_chars, least_times, every), "words")
    near = neighbours(vocabulary).join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    counted = vocabulary.join(best, "word", "left")
    form_n = -F.col("best.less")
    kept = form_n >= times * F.col("n")
    known = written(counted.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(kept, F.col("best.form")).alias("form"), F.when(kept, form_n).alias("form_n")), "forms")
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")
