"""Connected components of a link table by contraction, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)``: one root per component.

    Each round every node points at the member of its closed neighbourhood with the least hash
    (a new hash each round, so that no numbering of the nodes makes long chains), and the graph
    shrinks to the nodes pointed at. A constant share of the nodes goes each round, whatever the
    shape; a node with very many links is one pre-aggregated row per task. Self links and
    repeated links are allowed. An empty table gives an empty result.
    """
    edges = stash(links.where("a <> b").select("a", "b").distinct(), "links")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), c.alias("v"))
        step = stash(
            both.groupBy("a").agg(F.min(order(F.col("b"))).alias("best"))
            .select(F.col("a").alias("node"), F.least("best", order(F.col("a")))["v"].alias("root")),
            "steps",
        )
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = stash(
            edges.join(left, "a").join(right, "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = roots.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return roots
