"""Connected components of a link table by contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """`node, component`: the smallest node reachable, for every node of `links` (columns `a`, `b`, numbers).

    Each round every node points to the smallest of itself and its neighbours; links are then drawn between the
    nodes pointed to, and those that fell together go. Links shrink by at least half of the nodes that still have any,
    so rounds grow with the logarithm of the longest path. A hub of many links is one row per task after the partial
    minimum; the joins are plain equi-joins, which adaptive execution may split. Every round is settled in the shared
    folder. An empty link table gives an empty result.
    """
    links = settle(links.where("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.union(links.selectExpr("b AS a", "a AS b"))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_near"))
        step = settle(step.selectExpr("node", "least(node, _near) AS component"), "step")
        if found is None:
            found = step
        else:
            onward = step.selectExpr("node AS component", "component AS _next")
            found = settle(found.join(onward, "component", "left")
                           .selectExpr("node", "coalesce(_next, component) AS component"), "found")
        links = (links.join(step.selectExpr("node AS a", "component AS _a"), "a")
                 .join(step.selectExpr("node AS b", "component AS _b"), "b")
                 .where("_a <> _b").selectExpr("least(_a, _b) AS a", "greatest(_a, _b) AS b").distinct())
        links = settle(links, "links")
    if found is None:
        return links.selectExpr("a AS node", "b AS component")
    return found
