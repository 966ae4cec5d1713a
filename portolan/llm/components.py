"""Connected components of an edge table, as repeated joins that cut their lineage each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in ``edges`` (long columns ``a``, ``b``).

    Each round every id takes the smallest label among its neighbours and then the label of that
    label, until nothing changes. Labels are one row per id; an id with very many edges is split
    by the adaptive skew join and its labels are reduced before they are shuffled. Loops and
    repeated edges do no harm; without edges the result is empty.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("next"))
        root = labels.select(F.col("id").alias("next"), F.col("component").alias("root"))
        labels = stored(step.join(root, "next").select("id", "was", F.least("next", "root").alias("component")), "labels")
        if labels.filter("component <> was").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
