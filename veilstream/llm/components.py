"""Connected components of a graph of links, by union-find steps as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import cut, drop_cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of `links`; component is the smallest node that can be reached.

    Each round hangs every node's root under the smallest root among its neighbours (union) and then
    replaces parents by grandparents (find). Links whose ends share a root are dropped, so rounds shrink.
    A node with very many links is met by partial aggregation and joins that may be split. No links: no rows.
    """
    live = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct())
    nodes = live.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = cut(nodes.select("node", F.col("node").alias("root")))
    while live.limit(1).count():
        # union: among the roots at both ends of a link, the larger hangs under the smallest it meets
        hung = cut(live.groupBy(F.col("b").alias("old")).agg(F.min("a").alias("new")))
        moves = hung
        while True:  # find: shorten chains of moves
            up = moves.select(F.col("old").alias("new"), F.col("new").alias("top"))
            shorter = cut(moves.join(up, "new", "left").select("old", F.coalesce("top", "new").alias("new"), F.col("top").isNotNull().alias("moved")))
            if moves is not hung:
                drop_cut(moves)
            moves = shorter.select("old", "new")
            if not shorter.where("moved").limit(1).count():
                break
        to = moves.select(F.col("old").alias("root"), F.col("new"))
        newer = cut(roots.join(to, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        x, y = moves.select(F.col("old").alias("a"), F.col("new").alias("na")), moves.select(F.col("old").alias("b"), F.col("new").alias("nb"))
        left = live.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"))
        fewer = cut(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for old in (roots, live, hung, moves):
            drop_cut(old)
        roots, live = newer, fewer
    return roots.select("node", F.col("root").alias("component"))
