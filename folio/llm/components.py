"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """v, c for each vertex of edges(a, b): c is the smallest vertex reachable from v.

    Labels go along edges and then to the label of their label, until none changes, which takes rounds in proportion to
    the logarithm of the longest path in usual graphs. Every round is written to the shared folder. Edges with a null end
    count for nothing. A vertex of very many edges is a large partition of a plain join, which Spark splits."""
    both = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = cut(labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("j"))
        moved = cut(step.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("j", "c")).alias("c")))
        labels = moved.select("v", "c")
        if not moved.where("c <> old").limit(1).count():
            return labels
