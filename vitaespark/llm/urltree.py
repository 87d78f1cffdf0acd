"""URL filters: explicit rules, and per host a tree of path templates judged by labelled pages.

A path is a walk down its host's tree.  A segment that is frequent under its parent stays literal, all
others become a wildcard, so numbers, names and hashes fall together.  Sibling branches whose
labels do not differ significantly are merged.  A template is rejected if the smoothed share of good
labels (a beta prior at the overall share) is too low.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm.arrays import written
from vitaespark.llm.joins import salted_left

#: Levels of the tree; whatever lies deeper is one wildcard.
DEPTH = 3
#: A literal segment has so many pages at least, and such a share of its parent's.
LEAST_PAGES, LEAST_SHARE = 5, 0.01
#: Siblings merge while their shares of good labels differ by at most so many standard errors.
SIMILAR = 2.0
PRIOR_WEIGHT = 5.0
LEAST_PURITY = 0.6

WILD, DEEPER, MERGED = "*", "**", "~"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule (verdict, ``host/path``); null if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, action).otherwise(verdict)
    return text, verdict


def templates_of_pages(pages: DataFrame) -> DataFrame:
    """Add ``template`` to rows with ``page_id``, ``host`` and ``path``: the path's walk down its host's tree."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    walk = pages.withColumn("parts", parts).withColumn("template", F.lit(""))
    for level in range(DEPTH):
        walk = walk.withColumn("segment", F.get("parts", F.lit(level)))
        here = walk.where("segment is not null").groupBy("host", "template", "segment").agg(F.count("*").alias("n"))
        of_parent = F.sum("n").over(Window.partitionBy("host", "template"))
        # rare segments never become literal: what a parent's window holds is counts, not pages
        literal = here.withColumn("all", of_parent).where(
            (F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("all")))
        literal = literal.select("host", "template", "segment", F.lit(True).alias("literal"))
        name = F.when(F.col("segment").isNull(), "").when(F.col("literal"), F.concat(F.lit("/"), "segment")).otherwise(f"/{WILD}")
        walk = salted_left(walk, literal, ["host", "template", "segment"], "page_id")
        walk = walk.withColumn("template", F.concat("template", name)).drop("literal", "segment")
    deeper = F.when(F.size("parts") > DEPTH, f"/{DEEPER}").otherwise("")
    return walk.withColumn("template", F.concat("template", deeper)).drop("parts")


def _join_similar(state: Column, sibling: Column) -> Column:
    """Siblings in order of their share: the next one joins the cluster before it unless they differ significantly."""
    both = (state.g + sibling.g + 1) / (state.l + sibling.l + 2)
    variance = both * (1 - both) * (1 / state.l + 1 / sibling.l)
    apart = F.abs(state.g / state.l - sibling.g / sibling.l) > SIMILAR * F.sqrt(variance)
    new = F.when((state.l > 0) & (sibling.l > 0), apart).otherwise(F.lit(False))
    k = state.k + F.when(new, 1).otherwise(0)
    return F.struct(
        (F.when(new, 0).otherwise(state.l) + sibling.l).cast("long").alias("l"), (F.when(new, 0).otherwise(state.g) + sibling.g).cast("long").alias("g"),
        k.cast("int").alias("k"), F.concat(state.out, F.array(F.struct(sibling.branch.alias("branch"), k.cast("int").alias("k")))).alias("out"))


def judged_templates(pages: DataFrame, least_purity: float = LEAST_PURITY) -> DataFrame:
    """One row per host and template: pages, labels, the branch it was merged into, purity, verdict.

    ``pages`` has ``host``, ``template`` and ``good`` (1, 0 or null).
    """
    table = pages.groupBy("host", "template").agg(
        F.count("*").alias("pages"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    table = table.withColumn("branch", F.col("template"))
    for level in reversed(range(DEPTH)):
        # siblings at this level: templates equal but for this segment
        parts = F.split(F.substring("branch", 2, 1 << 30), "/")
        own = F.get(parts, F.lit(level))
        others = F.concat_ws("/", F.transform(parts, lambda s, i: F.when(i == level, "").otherwise(s)))
        branches = table.groupBy("host", "branch").agg(F.sum("labelled").alias("l"), F.sum("good").alias("g"))
        branches = branches.withColumn("others", others).withColumn("own", own)
        rate = F.when(F.col("l") > 0, F.col("g") / F.col("l")).otherwise(F.lit(2.0))
        # a parent has at most 1 / LEAST_SHARE literal children and a wildcard at each of its leaves
        siblings = branches.where("own is not null").groupBy("host", "others").agg(
            F.sort_array(F.collect_list(F.struct(rate.alias("rate"), "branch", "l", "g"))).alias("list"))
        nobody = F.expr("cast(array() as array<struct<branch:string,k:int>>)")
        start = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("g"), F.lit(0).alias("k"), nobody.alias("out"))
        grouped = siblings.select("host", "others", F.explode(F.aggregate("list", start, _join_similar, lambda s: s.out)).alias("x"))
        merged = F.concat(F.lit("/"), F.concat_ws("/", F.transform(parts, lambda s, i: F.when(
            i == level, F.concat(F.lit(MERGED), F.col("x.k"))).otherwise(s))))
        merged = grouped.select("host", F.col("x.branch").alias("branch"), "x").withColumn("into", merged)
        branches = branches.join(merged.select("host", "branch", "into"), ["host", "branch"], "left")
        branches = branches.withColumn("into", F.coalesce("into", "branch"))
        table = table.join(branches.select("host", "branch", "into"), ["host", "branch"])
        table = table.withColumn("branch", F.col("into")).drop("into")
    whole = table.agg((F.sum("good") / F.greatest(F.sum("labelled"), F.lit(1))).alias("prior"))
    of_branch = Window.partitionBy("host", "branch")
    table = table.crossJoin(F.broadcast(whole))  # one row
    purity = (F.sum("good").over(of_branch) + PRIOR_WEIGHT * F.coalesce("prior", F.lit(1.0))) / (
        F.sum("labelled").over(of_branch) + PRIOR_WEIGHT)
    purity = F.when(F.sum("labelled").over(of_branch) == 0, F.lit(1.0)).otherwise(purity)
    table = table.withColumn("purity", purity)
    return table.withColumn("verdict", F.when(F.col("purity") < least_purity, "block").otherwise("allow")).drop("prior")


def judge(pages: DataFrame, rules: list[tuple[str, str]], least_purity: float = LEAST_PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) of rows (page_id, url, good).

    A null URL or one without ``://`` has an empty host and path; such pages form a host of their own.
    Branches without labels are allowed.  Repeated rows are judged alike and all count; an empty table
    gives no rows.  Further columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"), F.col("good").cast("long").alias("good"))
    placed = written(templates_of_pages(known), "templates")
    blocked = judged_templates(placed, least_purity).where("verdict = 'block'").select("host", "template", "verdict")
    placed = salted_left(placed, blocked.withColumnRenamed("verdict", "by_tree"), ["host", "template"], "page_id")
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return placed.select(
        "page_id", "host", "path", text.alias("rule"),
        F.coalesce(verdict, "by_tree", F.lit("allow")).alias("verdict"), "template")
