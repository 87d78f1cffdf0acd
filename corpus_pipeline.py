"""A corpus from raw documents to packed sequences: five stages, each an operator on all that is left.

Every stage gets the documents its predecessor kept and returns documents with the same columns; the
last one returns pieces of packed sequences.  Between stages the rows are written to the shared folder.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaespark.llm import decontaminate, nearjoin, neighbours, packing, secrets
from vitaespark.llm.arrays import text_column, written
from vitaespark.llm.queries import GOOD, held_out, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours make them good; every fifth id is never learned from."""
    space = neighbours.fit(docs, table(spark, sf_dir, "labels").where(~held_out(5, 0)))
    scored = neighbours.score(docs, space).where(F.col("score") >= GOOD)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 80 % common five-word shingles, that of the smallest id.

    Rows are told apart by a hash of id and text, so rows without an id, and different texts with one id,
    are compared like all others; of equal rows one stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", text_column()))
    found = nearjoin.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), size=5, percent=80)
    groups = keyed.select("__key", "doc_id").distinct().join(found.select(F.col("doc_id").alias("__key"), "component_id").distinct(), "__key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__key")).alias("first")
    kept = groups.groupBy("component_id").agg(first).select("first.__key")
    by_key = Window.partitionBy("__key").orderBy("doc_id")
    left = keyed.join(kept, "__key", "left_semi").withColumn("__nth", F.row_number().over(by_key)).where("__nth = 1")
    return left.drop("__key", "__nth")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share with the benchmark; nothing but benchmark text goes."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return secrets.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Token ids and trained neighbours are beyond SQL; a brute-force version is among the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, applied to the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
