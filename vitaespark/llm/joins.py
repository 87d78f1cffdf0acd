"""Joins that spread frequent keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_left(left: DataFrame, right: DataFrame, keys: list[str], by: str, salts: int = SALTS) -> DataFrame:
    """Left join with a small table: rows of one key are dealt by a hash of column ``by``."""
    dealt = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*keys, "__salt"], "left").drop("__salt")
