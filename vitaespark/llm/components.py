"""Connected components of a link table, by label propagation with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaespark.llm.arrays import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b); the component is its smallest id.

    Each round takes the smallest label among neighbours, then the label's own label, and is written to
    the shared folder.  Labels only fall, and a round without a change is the last.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = written(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "links")
    labels = both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("low"))
    labels = written(labels.select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "component"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        of_label = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        after = written(lower.join(of_label, "component").select("id", "before", F.least("component", "next").alias("component")), "labels")
        changed = after.where("before <> component").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            return labels
