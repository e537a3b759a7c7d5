"""Root-cause, dependency and impact scores over traversal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.functions.scalars import risk_label
from freightloom.operators.graph_walk import degrees, orient, reach, risky_paths

DECAY = 0.7


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def propagate_impact(nodes: DataFrame, edges: DataFrame, source: DataFrame, depth: int = 3, risk: float = 1.0) -> DataFrame:
    """Risk passed on to every node within reach; the least depth decides."""
    found = reach(orient(edges), source, depth).where("depth > 0")
    share = F.lit(risk) * F.pow(F.lit(DECAY), F.col("depth"))
    return found.join(nodes, "node_id").select(
        "node_id", "label", "depth", r(share).alias("risk_contribution"), risk_label(share).alias("risk_level")
    )


def dependency_rank(nodes: DataFrame, edges: DataFrame, target: DataFrame, depth: int = 3, top: int = 15) -> DataFrame:
    """(0.4 risk + 0.3 connectivity + 0.3 distance factor), upstream x 1.2, downstream x 0.8."""
    up = reach(orient(edges, "in"), target, depth).where("depth > 0").withColumn("direction", F.lit("parent"))
    down = reach(orient(edges, "out"), target, depth).where("depth > 0").withColumn("direction", F.lit("child"))
    d = up.unionByName(down).join(nodes.select("node_id", "label", "risk"), "node_id").join(
        degrees(edges).select("node_id", "degree"), "node_id"
    )
    conn = F.least(F.col("degree") / 15.0, F.lit(1.0))
    base = F.col("risk") * 0.4 + conn * 0.3 + 1 / (1 + F.col("depth") * 0.3) * 0.3
    score = base * F.when(F.col("direction") == "parent", 1.2).otherwise(0.8)
    return d.select(
        "node_id", "label", "direction", F.col("depth").alias("distance"), r(score).alias("score"),
        ((conn > 0.6) & (F.col("risk") > 0.3)).cast("int").alias("is_bottleneck"),
        ((F.col("risk") > 0.5) & (F.col("depth") <= 2)).cast("int").alias("is_critical"),
    ).orderBy(F.desc("score"), "node_id", "direction").limit(top)


def chains(nodes: DataFrame, edges: DataFrame, target: DataFrame, hops: int = 4, top: int = 10, floor: float = 0.2) -> DataFrame:
    """The `top` riskiest directed walks from a risky root into the target: chain_id, total, path (root first)."""
    risk = nodes.select("node_id", "risk")
    found = risky_paths(orient(edges, "in"), target, risk, hops)
    roots = found.where(F.size("path") > 1).join(risk.where(F.col("risk") > floor), "node_id")
    best = roots.select("total", F.reverse("path").alias("path")).orderBy(F.desc("total"), F.desc("path")).limit(top)
    return best.withColumn("chain_id", F.array_join("path", ">"))


def chain_nodes(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    return chain.select("chain_id", F.posexplode("path").alias("position", "node_id")).join(
        nodes.select("node_id", "label", "risk"), "node_id"
    )


def chain_confidence(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean of min(1, risk x decay^position + 0.2) over the nodes of a chain, with its root cause."""
    c = F.least(F.col("risk") * F.pow(F.lit(DECAY), F.col("position")) + 0.2, F.lit(1.0))
    return chain_nodes(chain, nodes).groupBy("chain_id").agg(
        r(F.avg(c)).alias("confidence"), F.count(F.lit(1)).alias("chain_length"),
        F.min_by("node_id", "position").alias("root_cause"), F.min_by("risk", "position").alias("root_risk"),
    )


def recommend_path(chain: DataFrame, nodes: DataFrame) -> DataFrame:
    """Path with the best average risk per length and its riskiest node (the first one on ties)."""
    g = chain_nodes(chain, nodes).groupBy("chain_id").agg(
        F.avg("risk").alias("a"), F.max("risk").alias("max_risk"), F.count(F.lit(1)).alias("length"),
        F.max_by("node_id", F.struct("risk", (-F.col("position")).alias("p"))).alias("bottleneck"),
    )
    return g.select(
        "chain_id", r(F.col("a")).alias("avg_risk"), r(F.col("max_risk")).alias("max_risk"), "length", "bottleneck",
        r(F.col("a") / F.col("length")).alias("path_score"),
    ).orderBy(F.desc("path_score"), F.desc("chain_id")).limit(1)


def relationship_weights(edges: DataFrame, target: DataFrame, candidates: DataFrame) -> DataFrame:
    """Strength of a direct edge to the target, else 0.3 within two hops, else 0.1."""
    adj = orient(edges)
    direct = adj.join(target.withColumnRenamed("node_id", "src"), "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(
        F.max("strength").alias("direct")
    )
    near = reach(adj, target, 2).where("depth = 2").select("node_id", F.lit(0.3).alias("near"))
    return candidates.join(direct, "node_id", "left").join(near, "node_id", "left").withColumn(
        "rel_weight", F.coalesce("direct", "near", F.lit(0.1))
    ).drop("direct", "near")


def risk_contribution(candidates: DataFrame) -> DataFrame:
    """Five layers: node or predicted risk, actuals, inferred edge, relationship, history."""
    actual = F.least(F.col("actual_delay_days") / 10 + F.col("actual_late") * 0.4, F.lit(1.0))
    total = (
        0.25 * F.greatest("risk", "predicted_risk") + 0.25 * F.greatest(actual, F.lit(0.0)) + 0.20 * F.col("inferred_weight")
        + 0.15 * F.col("rel_weight") + 0.15 * F.col("history_weight")
    )
    return candidates.select("node_id", "label", r(total, 8).alias("total_score"), risk_label(total).alias("risk_level"))
