"""The registered queries of this package: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaespark.llm import chunks, contexttree, decontaminate, multiindex, nearjoin, neighbours, oracles, orderhash, packing, ranked, secrets, spelling, urltree, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op1_decontaminate": oracles.decontaminated(decontaminate.WINDOW),
    "op6_warc": oracles.archived(),
    "op8_near_duplicates": oracles.near_duplicates(4, 80),
    "op12_spelling_variants": oracles.spelling_variants(6, 5, 199, 5),
    "op13_ranked_search": oracles.ranked(10),
}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(of: int, rest: int):
    """Whether crc32 of the id as text leaves a remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == rest


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.scan(documents, table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h.end - h.start).cast("long")
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query
def op2_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return orderhash.edited_fingerprints(table(spark, folder, "documents"))


#: Fixed rules of the URL filter's query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op3_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A page's label is that of the document whose number its path holds."""
    labels = table(spark, folder, "labels").groupBy("doc_id").agg(F.min("quality").alias("good"))
    _, path = urltree.host_and_path(F.col("url"))
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.regexp_extract(path, "/([0-9]{1,18})(?:[^0-9]|$)", 1).try_cast("long").alias("doc_id"))
    return urltree.judge(pages.join(labels, "doc_id", "left"), RULES)


#: Score from which a document counts as good.
GOOD = 0.3


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    space = neighbours.fit(documents, table(spark, folder, "labels").where(~held_out(5, 0)))
    scored = neighbours.score(documents, space)
    return scored.select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


@query
def op5_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return contexttree.score(table(spark, folder, "documents"), held_out(7, 2))


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


@query
def op7_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


@query
def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind != "random")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return nearjoin.near_duplicates(table(spark, folder, "documents"), size=4, percent=80, hubs=(2,))


@query
def op9_shared_passages(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeats(table(spark, folder, "documents"))


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents").select("doc_id", "text"), least_chars=6, least_times=5, every=199, times=5)


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.rank(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), k=10)


@query
def op11_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return multiindex.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)
