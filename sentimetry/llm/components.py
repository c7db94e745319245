"""Connected components of a link table, by hooking and contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``links`` (a, b) -> (node, root): root is the least node of its component.

    A round hooks every node to its least neighbour, follows hooks to their
    ends (doubling the reach each time), and contracts the links to those ends:
    at least half of the linked nodes go in a round, and links inside a
    component are read once.  ``known``: components of earlier links, which the
    new ones extend.
    """
    if known is not None:
        to = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        links = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
        fresh = links.select(F.explode(F.array(F.when(F.col("a_root").isNull(), F.col("a")), F.when(F.col("b_root").isNull(), F.col("b")))).alias("node")).where("node is not null").distinct()
        known = stored(known.unionByName(fresh.select("node", F.col("node").alias("root"))), "roots")
        links = links.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = known
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")), "hooks")
        if roots is not None and hook.isEmpty():
            return roots
        while True:  # two doublings between writes
            for _ in range(2):
                above = hook.select(F.col("node").alias("up"), F.col("up").alias("above"))
                hook = hook.select("node", "up").join(above, "up").select("node", F.col("above").alias("up"), (F.col("above") < F.col("up")).alias("moved"))
            hook = stored(hook, "hooks")
            if hook.where("moved").isEmpty():
                break
        hook = hook.select("node", "up")
        end = lambda c: hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        edges = edges.join(end("a"), "a").join(end("b"), "b").where("a_up <> b_up")
        edges = stored(edges.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        if roots is None:
            roots = hook.withColumnRenamed("up", "root")
        else:
            above = hook.select(F.col("node").alias("root"), "up")
            roots = stored(roots.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
