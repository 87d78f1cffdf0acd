"""Document operators: lines, sections, source lines, page layout."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaespark import fixed
from vitaespark.functions import text as T
from vitaespark.functions.strings import bind, trimmed, unempty
from vitaespark.operators import ordered


#: Needles of one document that are looked up together.
NEEDLES_PER_TASK = 10_000


def normalize(df: DataFrame, text: str = "text") -> DataFrame:
    """T1 on a column."""
    return df.withColumn(text, T.normalize_text(F.col(text)))


def explode_lines(df: DataFrame, keys: list[str], text: str = "text", strip: bool = False) -> DataFrame:
    """One row per line with its 0-based number."""
    source = trimmed(F.col(text)) if strip else F.col(text)
    return df.select(*keys, F.posexplode(T.line_array(source)).alias("line_no", "line"))


def explode_sections(df: DataFrame, keys: list[str], text: str = "text", merge_header: bool = True) -> DataFrame:
    """T4, T5: one row per non-blank line with its section; no shuffle."""
    runs = df.select(*keys, F.explode(T.section_runs(F.col(text), merge_header)).alias("run"))
    lines = runs.select(*keys, "run.section_key", F.explode("run.lines").alias("x"))
    return lines.select(*keys, "section_key", "x.line_no", "x.line")


def locate_lines(needles: DataFrame, documents: DataFrame, key: str, needle: str = "needle",
                 text: str = "text") -> DataFrame:
    """Number of the source line for every needle, -1 when there is none.

    The needles of a document (in parts of about ``NEEDLES_PER_TASK``) meet its text once, which is
    cut into lines once for all of them.
    """
    heavy = ordered.heavy_keys(needles, key, NEEDLES_PER_TASK)
    part = F.coalesce(F.pmod(F.xxhash64(F.col(needle)), F.col("_salts")), F.lit(0))
    parted = needles.join(heavy, needles[key] == heavy["_key"], "left").withColumn("_part", part)
    gathered = parted.groupBy(key, "_part").agg(F.collect_list(F.struct(*needles.columns)).alias("_needles"))
    joined = gathered.join(documents.select(key, F.col(text).alias("_text")), key)

    def located(lines):
        return F.transform("_needles", lambda n: F.struct(n.alias("n"), T.line_of(lines["raw"], lines["line"], n[needle]).alias("line_no")))

    raw = T.line_array(trimmed(F.col("_text")))
    lines = bind(raw, lambda x: F.struct(x.alias("raw"), F.transform(x, trimmed).alias("line")))
    return joined.select(F.explode(bind(lines, located)).alias("x")).select("x.n.*", "x.line_no")


def blank_page_warning(pages: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per document, pages, blank pages and whether more than half are blank."""
    blank = unempty(trimmed(F.col(text))).isNull()
    return pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(blank).alias("blank_pages"),
    ).withColumn("warned", F.col("blank_pages") > F.col("page_count") * 0.5)


def gap_clusters(df: DataFrame, keys: list[str], position: str, factor: float = 3, floor: float = 30,
                 blocks: int | None = None) -> DataFrame:
    """Number the clusters of positions that wide gaps separate.

    A gap is wide when above ``factor`` times the upper median of the positive gaps and above ``floor``.
    """
    cut = ordered.in_blocks(df, keys, [position], blocks)
    gaps = ordered.previous_value(cut, keys, position, "_prev").withColumn("_gap", F.col(position) - F.col("_prev")).drop("_prev")
    median = ordered.value_at_rank(
        gaps.filter(F.col("_gap") > 0), keys, "_gap", lambda n: F.floor(n / 2) + 1, "_median", blocks).drop("n")
    limit = F.greatest(F.col("_median") * factor, F.lit(floor))
    marked = ordered.with_key_values(gaps, median, keys).withColumn(
        "_break", F.coalesce(F.col("_gap") > limit, F.lit(False)).cast("bigint"))
    return ordered.running(
        marked, keys, [position, F.col("_break").desc()], F.col("_break"), "cluster_id").drop("_gap", "_median", "_break", "_block")


def words_to_lines(words: DataFrame, keys: list[str], tolerance: float = 5) -> DataFrame:
    """Lines of a page from word boxes; a line takes words within reach of its first word."""
    # a page's words travel as plain arrays: as structs they would take nearly twice the room
    parts = ("top", "x0", "text")
    empty = {c: F.lit("" if c == "text" else 0).cast(words.schema[c].dataType) for c in parts}
    bits = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(parts)), F.lit(0)).cast("tinyint")
    plain = words.select(*keys, *[F.coalesce(F.col(c), empty[c]).alias(c) for c in parts], bits.alias("nulls"))
    lists = plain.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in (*parts, "nulls")])

    def box(null, i):
        return F.struct(*[F.when(null.bitwiseAND(1 << k) == 0, F.get(c, i)).alias(c) for k, c in enumerate(parts)])

    boxes = F.when(F.array_max("nulls") > 0, F.transform("nulls", box)).otherwise(F.arrays_zip(*parts))
    pages = lists.select(*keys, F.sort_array(boxes).alias("boxes"))

    def step(state, box_at):
        far = F.abs(box_at["top"] - state["anchor"]) > tolerance
        new = state["anchor"].isNull() | far
        return F.struct(
            F.when(new, box_at["top"]).otherwise(state["anchor"]).alias("anchor"),
            F.when(new, F.concat(state["starts"], F.array(box_at["at"]))).otherwise(state["starts"]).alias("starts"),
        )

    def line_texts(boxes):
        tops = F.transform(boxes, lambda b, i: F.struct(b["top"].alias("top"), i.alias("at")))
        empty = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(tops, empty, step, lambda state: state["starts"])
        whole = F.struct(starts.alias("at"), boxes["text"].alias("text"))
        return bind(whole, lambda w: F.transform(w["at"], lambda start, i: F.array_join(
            F.slice(w["text"], start + 1, F.coalesce(F.get(w["at"], i + 1), F.size(w["text"])) - start), " ")))

    return pages.select(*keys, F.posexplode(line_texts(F.col("boxes"))).alias("line_no", "line"))


def file_report(df: DataFrame, text: str = "text") -> DataFrame:
    """S3: mark rows without any text as failures instead of raising."""
    filled = unempty(trimmed(F.coalesce(F.col(text), F.lit("")))).isNotNull()
    return df.withColumns({
        "success": filled, "error": F.when(~filled, fixed.EMPTY_TEXT_ERROR).otherwise(F.lit("")),
    })


def split_report(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: usable rows and quarantined rows."""
    return df.filter("success"), df.filter("not success")
