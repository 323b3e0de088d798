"""Connected components of a link table, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.store import cut, discard


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each linked node, a long, the smallest node it can reach.

    In each round every node is named after the one of least hash among
    itself and its neighbours, and only the links between different names
    are left, so the tables of the rounds shrink, whatever the order of the
    nodes; their sum is in proportion to the first one's.  Then the names
    are followed back, each round's once.  ``xxhash64`` of a long is one to
    one, so the names have no ties.  Neighbours and repeated links are
    summed up before the shuffle, and the name side of the joins has one row
    per node, so a node with very many links can be split.  Each round is
    written to the shared folder.  Links of a node to itself and repeated
    links are harmless; null ends are dropped.  No links: no rows.
    """
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges, rounds = cut(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()), []
    while not rounds or not edges.isEmpty():
        near = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
        rounds.append(cut(near.select(F.col("u").alias("node"), F.when(F.xxhash64("v") < F.xxhash64("u"), F.col("v")).otherwise(F.col("u")).alias("name"))))
        name = lambda of, new: rounds[-1].select(F.col("node").alias(of), F.col("name").alias(new)).hint("merge")
        named = edges.join(name("u", "_a"), "u").join(name("v", "_b"), "v").where("_a <> _b")
        before, edges = edges, cut(named.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).distinct())
        discard(before)
    roots = rounds[-1]
    for names in rounds[-2::-1]:
        later = roots.select(F.col("node").alias("name"), F.col("name").alias("later")).hint("merge")
        roots = names.join(later, "name", "left").select("node", F.coalesce("later", "name").alias("name"))
    roots = cut(roots)
    least = roots.groupBy("name").agg(F.min("node").alias("root")).hint("merge")
    out = cut(roots.join(least, "name").select("node", "root"))
    discard(edges, roots, *rounds)
    return out
