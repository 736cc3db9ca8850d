"""Connected components by min-neighbour contraction, all in DataFrames.

Each round gives every node the smallest of itself and its neighbours as parent, follows parents to their roots by
doubling, replaces both ends of each link by their roots and drops links within a root. The rounds end when no link is
left, after about log(nodes) of them. A hub's links are folded by a map-side combined minimum, never gathered; each
round's tables are written to the shared folder, so lineage stays short and lost executors cost a read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martflow.llm.shared import Scratch, spread_join


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node in links; root is the smallest node that it reaches."""
    scratch = scratch or Scratch(links.sparkSession)
    written = scratch.written
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    most = 2 * edges.count()  # no table of nodes or links below has more rows
    labels = None
    while most and (labels is None or not edges.isEmpty()):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "parents")
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("g"))
            higher = spread_join(parent, up, "p", "left", rows=most)
            moved = F.coalesce("g", "p") != F.col("p")
            jumped = written(higher.select("u", F.coalesce("g", "p").alias("p"), moved.alias("moved")), "parents")
            scratch.free(parent)
            parent = jumped
            if jumped.filter("moved").isEmpty():
                break
        first = parent.select("u", F.col("p").alias("pu"))
        second = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        ends = spread_join(spread_join(edges, first, "u", rows=most), second, "v", rows=most).filter("pu <> pv")
        before, edges = edges, written(ends.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        scratch.free(before)
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
            lower = spread_join(labels, up, "root", "left", rows=most).select("node", F.coalesce("next", "root").alias("root"))
            before, labels = labels, written(lower, "labels")
            scratch.free(before, parent)
    return labels if labels is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
