"""Connected components over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every end of the links (a, b): comp is the smallest node reachable.

    Each round takes the least label among neighbours (combined before the shuffle)
    and then the label's own label, so long chains shrink fast. Nothing is collected.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("comp"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("_c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_c"))
        new = labels.join(near, "node").select("node", F.least("comp", "_c").alias("comp"), F.col("comp").alias("_old"))
        jump = new.select(F.col("node").alias("comp"), F.col("comp").alias("_j"))
        new = cut(new.join(jump, "comp", "left").select("node", F.coalesce("_j", "comp").alias("comp"), "_old"))
        changed = not new.filter("comp <> _old").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels
