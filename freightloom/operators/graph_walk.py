"""Traversals and iterative measures on edge tables.

A traversal keeps a frontier table and joins it with the edges once per step. Each step is checkpointed, which keeps plans short and
lets a lost executor recover from files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.session import checkpoint, written

# Trust in an edge by its type; anything else counts 0.5.
EDGE_TRUST = {
    "SUPPLIES": 1.0, "STORED_IN": 1.0, "SHIPS_VIA": 1.0, "DELIVERED_TO": 1.0, "PLACED": 1.0, "CONTAINS": 1.0,
    "INFLUENCES": 0.9, "INFERRED": 0.6,
}


def edge_trust(rel_type: str = "rel_type") -> Column:
    c = F.lit(0.5)
    for name, trust in EDGE_TRUST.items():
        c = F.when(F.col(rel_type) == name, trust).otherwise(c)
    return c


def orient(edges: DataFrame, direction: str = "both") -> DataFrame:
    """Edges to follow: out (src to dst), in (dst to src) or both ways."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return {"out": lambda: edges, "in": lambda: turned, "both": lambda: edges.unionByName(turned)}[direction]()


def reach(adj: DataFrame, sources: DataFrame, max_depth: int = 3) -> DataFrame:
    """Nodes within `max_depth` steps with their least depth and the best trust of a last edge.

    `sources` has node_id; the result includes them at depth 0.
    """
    hop = adj.select("src", "dst", edge_trust().alias("trust"))
    frontier = checkpoint(sources.select("node_id").distinct().select("node_id", F.lit(0).alias("depth"), F.lit(1.0).alias("trust")))
    seen = frontier
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("node_id").alias("src")).join(hop, "src").groupBy(F.col("dst").alias("node_id")).agg(
            F.max("trust").alias("trust")
        )
        frontier = checkpoint(
            found.join(seen, "node_id", "left_anti").select("node_id", F.lit(depth).alias("depth"), "trust")
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def k_hop(adj: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """Nodes at the end of a walk of exactly k steps, the sources excluded."""
    at = sources.select("node_id").distinct()
    pairs = adj.select("src", "dst")
    for _ in range(k):
        at = at.withColumnRenamed("node_id", "src").join(pairs, "src").select(F.col("dst").alias("node_id")).distinct()
    return at.join(sources, "node_id", "left_anti")


def shortest_paths(adj: DataFrame, source: DataFrame, max_hops: int) -> DataFrame:
    """For every node within reach: hops and the smallest (by ids) of its shortest paths."""
    pairs = adj.select("src", "dst")  # a pair met twice gives the same least path
    frontier = checkpoint(source.select("node_id", F.array("node_id").alias("path")))
    seen = frontier
    for _ in range(max_hops):
        found = frontier.withColumnRenamed("node_id", "src").join(pairs, "src").groupBy(F.col("dst").alias("node_id")).agg(
            F.min("path").alias("path")
        )
        frontier = checkpoint(
            found.join(seen, "node_id", "left_anti").select("node_id", F.concat("path", F.array("node_id")).alias("path"))
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select("node_id", (F.size("path") - 1).alias("hops"), "path")


def weighted_paths(adj: DataFrame, source: DataFrame, max_hops: int) -> DataFrame:
    """Least cost (sum of 1 / strength) and its path for every node within `max_hops` edges."""
    hop = adj.where("strength > 0").groupBy("src", "dst").agg((1 / F.max("strength")).alias("w"))
    state = checkpoint(source.select("node_id", F.lit(0.0).alias("cost"), F.array("node_id").alias("path")))
    for _ in range(max_hops):
        step = state.withColumnRenamed("node_id", "src").join(hop, "src").select(
            F.col("dst").alias("node_id"), (F.col("cost") + F.col("w")).alias("cost"),
            F.concat("path", F.array("dst")).alias("path"),
        )
        best = state.unionByName(step).groupBy("node_id").agg(F.min(F.struct("cost", "path")).alias("b"))
        state = checkpoint(best.select("node_id", "b.cost", "b.path"))
    return state


def risky_paths(adj: DataFrame, start: DataFrame, risk: DataFrame, hops: int) -> DataFrame:
    """Per node and length, the walk from the start with the largest summed node risk.

    The best walk of k edges to a node extends a best walk of k - 1 edges to one of its predecessors, so carrying one walk per
    (node, length) is exact and the table never exceeds nodes x hops.
    """
    pairs = adj.select("src", "dst")  # a pair met twice gives the same walk
    state = checkpoint(start.join(risk, "node_id").select("node_id", F.col("risk").alias("total"), F.array("node_id").alias("path")))
    kept = state
    for _ in range(hops):
        step = state.withColumnRenamed("node_id", "src").join(pairs, "src").groupBy(F.col("dst").alias("node_id")).agg(
            F.max(F.struct("total", "path")).alias("b")
        )
        state = checkpoint(step.join(risk, "node_id").select(
            "node_id", (F.col("b.total") + F.col("risk")).alias("total"), F.concat("b.path", F.array("node_id")).alias("path"),
        ))
        kept = kept.unionByName(state)
    return kept


def degrees(edges: DataFrame) -> DataFrame:
    """Incident, incoming and outgoing edges per node; counted per side before the two are added."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n_in"))
    zero = F.lit(0).cast("long")
    both = out.select("node_id", "n_out", zero.alias("n_in")).unionByName(into.select("node_id", zero.alias("n_out"), "n_in"))
    return both.groupBy("node_id").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")).withColumn(
        "degree", F.col("n_out") + F.col("n_in")
    )


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 3) -> DataFrame:
    """Rank after a fixed number of rounds: 1 - damping plus damping times the share passed on by predecessors."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"))
    start = 1 / nodes.agg(F.count(F.lit(1))).scalar()
    state = checkpoint(
        nodes.select("node_id").join(out, nodes.node_id == out.src, "left")
        .select("node_id", "n_out", start.alias("rank"))
    )
    pairs = edges.select(F.col("src").alias("node_id"), "dst")
    for _ in range(rounds):
        given = pairs.join(state, "node_id").groupBy("dst").agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        state = checkpoint(
            state.join(given, state.node_id == given.dst, "left").select(
                "node_id", "n_out", (F.coalesce(F.col("got"), F.lit(0.0)) * damping + (1 - damping)).alias("rank")
            )
        )
    return state.select("node_id", "rank")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components, each labelled by its least node: node_id, component for every row of `nodes`.

    A round points every node that has a lower neighbour to the least one, follows pointers once, and draws the links between the nodes pointed to. Links
    inside what has become one node are gone, so all links are read in the first round only; it ends when none is left. A node kept by a round has taken in a
    neighbour or takes part in a lower one in the next, so two rounds at least halve the nodes with links. Links to nodes not in the table do not connect.
    """
    ids = nodes.select("node_id")
    links = edges.select("src", "dst").where("src <> dst").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    links = written(links.select("src", "dst"), "links")
    turns = []
    while not links.isEmpty():
        lower = orient(links).groupBy(F.col("src").alias("node_id")).agg(F.min("dst").alias("to")).where("to < node_id")
        lower = written(lower, "pointers")
        jump = lower.select(F.col("node_id").alias("to"), F.col("to").alias("next"))
        turn = written(lower.join(jump, "to", "left").select("node_id", F.coalesce("next", "to").alias("to")), "turn")
        turns.append(turn)
        for end in ("src", "dst"):
            links = links.join(turn.select(F.col("node_id").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        links = written(links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    # The last turns are the smallest; each is put behind the one before.
    whole = None
    for turn in reversed(turns):
        if whole is None:
            whole = turn
        else:
            later = whole.select(F.col("node_id").alias("to"), F.col("to").alias("next"))
            moved = turn.join(later, "to", "left").select("node_id", F.coalesce("next", "to").alias("to"))
            # A node that has moved may stand for others in later turns, but goes itself where its own turn says.
            whole = written(moved.unionByName(whole.join(turn.select("node_id"), "node_id", "left_anti")), "turns")
    if whole is None:
        return nodes.select("node_id", F.col("node_id").alias("component"))
    return nodes.select("node_id").join(whole, "node_id", "left").select("node_id", F.coalesce("to", "node_id").alias("component"))
