"""Connected components by hooking and shortcutting over a parent table.

Every round hooks each vertex to its least neighbour and shortcuts the parents twice,
then relabels the edges by their roots and drops those inside a component, so the edge
table shrinks until it is empty. Parents and edges are tables joined on vertices; nothing
is gathered by component, so one component may hold any share of all vertices. Rounds
are cut by checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the least vertex that each vertex of `edges` (u, v: bigint) is connected with.

    Loops and repeated edges do no harm; edges with a null end are left out; no edges give
    no rows. Vertices without an edge to another do not come out.
    """
    known = edges.where("u is not null and v is not null and u <> v")
    rest = cut(known.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    parents = None
    while not rest.isEmpty():
        # v > u, so hooking every v to its least neighbour links strictly downwards: a forest.
        hooks = rest.groupBy("v").agg(F.min("u").alias("parent")).withColumnRenamed("v", "x")
        for _ in range(2):
            above = hooks.select(F.col("x").alias("parent"), F.col("parent").alias("grandparent"))
            hooks = hooks.join(above, "parent", "left").select("x", F.coalesce("grandparent", "parent").alias("parent"))
        hooks = cut(hooks)
        new = hooks if parents is None else parents.join(hooks.select(F.col("x").alias("parent"), F.col("parent").alias("root")), "parent", "left").select("x", F.coalesce("root", "parent").alias("parent")).unionByName(hooks)
        parents = cut(new)
        one = hooks.select(F.col("x").alias("u"), F.col("parent").alias("pu"))
        two = hooks.select(F.col("x").alias("v"), F.col("parent").alias("pv"))
        moved = rest.join(one, "u", "left").join(two, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
        rest = cut(moved.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if parents is None:
        return known.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    # A vertex hooked in one round may be hooked again under another name only through its root, so x is unique.
    roots = parents.select(F.col("parent").alias("x")).distinct().join(parents, "x", "left_anti").select("x", F.col("x").alias("parent"))
    return parents.unionByName(roots).select(F.col("x").alias("vertex"), F.col("parent").alias("component"))
