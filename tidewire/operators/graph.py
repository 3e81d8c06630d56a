"""Connected components by contracting the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewire.shared import materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label every node with the smallest node of its component.

    ``nodes(node)`` and ``edges(a, b)`` share one orderable type; an edge end that is no node is ignored and
    a null node or end drops out. Returns ``(node, label)``, one row per distinct node; no edges: each node
    is its own label. In a round every node hooks on to the first of its neighbours in a hashed order, new each round, hooks
    are followed twice over, and edges are drawn anew between what is left: chains break at random places, so the rounds
    grow with the logarithm of the nodes, and their tables shrink. Each is written to the shared folder, which also cuts the lineage.
    """
    nodes = materialize(nodes.select(F.col("node")).where("node is not null").distinct(), "nodes")
    known = lambda s: nodes.select(F.col("node").alias(s))
    ends = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    links = ends.distinct().join(known("a"), "a", "left_semi").join(known("b"), "b", "left_semi").select("a", "b")
    links = materialize(links, "links")
    roots, turn = None, 0
    while not links.isEmpty():
        turn += 1
        hooks = materialize(hooked(links, lambda x: F.xxhash64(x, F.lit(turn))), "hooks")
        far = followed(hooks, hooks)
        hooks = materialize(followed(far, far), "hooks")
        # Nodes that the rounds before brought down to a hooked one follow it.
        roots = hooks if roots is None else materialize(followed(roots, hooks), "roots")
        to = lambda s: hooks.select(F.col("node").alias(s), F.col("up").alias(f"to_{s}"))
        links = links.join(to("a"), "a").join(to("b"), "b").where("to_a <> to_b")
        links = links.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        links = materialize(links, "links")
    if roots is None:
        return nodes.select("node", F.col("node").alias("label"))
    # Every node with an edge was hooked in the first round, and is above its own root.
    least = roots.groupBy("up").agg(F.min(F.least("node", "up")).alias("label"))
    labels = roots.join(least, "up").select("node", "label")
    return labels.unionByName(nodes.join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("label")))


def hooked(links: DataFrame, order) -> DataFrame:
    """``(node, up)``: for each end of an edge the first of its neighbours and itself in ``order``."""

    def place(x: Column) -> Column:
        return F.struct(order(x).alias("h"), x.alias("x"))

    both = links.union(links.select("b", "a"))
    first = both.groupBy(F.col("a").alias("node")).agg(F.min(place(F.col("b"))).alias("first"))
    return first.select("node", F.least(F.col("first"), place(F.col("node")))["x"].alias("up"))


def followed(hooks: DataFrame, then: DataFrame) -> DataFrame:
    """Hooks and the hook of what they lead to; what ``then`` does not know stays."""
    on = then.select(F.col("node").alias("via"), F.col("up").alias("far"))
    return hooks.join(on, hooks.up == on.via, "left").select("node", F.coalesce("far", "up").alias("up"))
