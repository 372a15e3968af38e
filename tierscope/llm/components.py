"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of the links (a, b), root the smallest it reaches.

    Each round a node takes the smallest root of its neighbours, then that root's own root,
    so distances halve and long chains need few rounds. Minima are combined before shuffles,
    so a node with very many links is no burden to one task. Nulls are no nodes.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    both = saved(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .distinct(),
        "links",
    )
    roots = both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("root")
    )
    changed = 1
    roots = saved(roots, "roots")
    while changed:
        near = both.join(roots, both.b == roots.node).select(F.col("a").alias("node"), "root")
        least = near.union(roots).groupBy("node").agg(F.min("root").alias("root"))
        least = least.alias("l").join(
            roots.select(F.col("node").alias("r"), F.col("root").alias("further")),
            F.col("l.root") == F.col("r"),
        ).select("node", F.least("root", "further").alias("root"))
        compared = least.join(
            roots.withColumnRenamed("root", "old"), "node"
        ).select("node", "root", (F.col("root") < F.col("old")).alias("changed"))
        stored = saved(compared, "roots")
        changed = stored.where("changed").count()
        roots = stored.select("node", "root")
    return roots
