"""Traversals, iterative measures and scores over the stored graph."""

from pyspark.sql import functions as F

from freightloom.functions.scalars import risk_label
from freightloom.operators import graph_build as B
from freightloom.operators import graph_score as S
from freightloom.operators import graph_walk as G
from freightloom.operators.analytics import r
from freightloom.plans import graph_views as V
from freightloom.plans.graph_build import PICK, graph_query, pick
from freightloom.plans.graph_views import title
from freightloom.plans.patterns import BASE as EVENT_VIEWS
from freightloom.plans.patterns import EDGES as INFERRED
from freightloom.plans.patterns import load_edges, load_events
from freightloom.plans.registry import register, with_views
from freightloom.sources import GRAPH_COLUMNS, order_lines

TRUST = ("CASE rel_type " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in G.EDGE_TRUST.items())
         + " ELSE CAST(0.5 AS DOUBLE) END")
INTO = "SELECT dst AS src, src AS dst, rel_type, strength FROM edges"
RISK = "CASE WHEN {c} >= 0.75 THEN 'critical' WHEN {c} >= 0.5 THEN 'high' WHEN {c} >= 0.25 THEN 'medium' ELSE 'low' END"


def reach_views(label: str, depth: int, adj: str = "adj", name: str = "rch") -> dict[str, str]:
    """Views that hold least depth and trust, level by level."""
    views = {f"{name}0": f"SELECT min(node_id) AS node_id, 0 AS depth, CAST(1 AS DOUBLE) AS trust FROM nodes WHERE label = '{label}'"}
    for k in range(1, depth + 1):
        views[f"{name}{k}"] = (
            f"SELECT dst AS node_id, {k} AS depth, max({TRUST}) AS trust FROM {name}{k - 1} JOIN {adj} ON src = node_id GROUP BY dst"
        )
    levels = " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(depth + 1))
    views[name] = f"SELECT node_id, min(depth) AS depth, arg_min(trust, depth) AS trust FROM ({levels}) GROUP BY node_id"
    return views


def reached(n, e, label, depth, direction="both"):
    return G.reach(G.orient(e, direction), pick(n, label), depth).where("depth > 0").join(n, "node_id")


_OUT = "SELECT node_id, label, depth, trust FROM rch JOIN nodes USING (node_id) WHERE depth > 0"
graph_query("bfs_observed", lambda n, e: reached(n, e, "Supplier", 3).select("node_id", "label", "depth", "trust"), _OUT, **reach_views("Supplier", 3))

_NAME = "CASE WHEN {s}_type IN ('Supplier', 'Product', 'Warehouse') THEN {t} ELSE {s}_id END"
_NID = {s: f"substr(md5({s}_type || ':' || {_NAME.format(s=s, t=title(s + '_id'))}), 1, 12)" for s in ("source", "target")}
AS_OF = "(SELECT max(ts) + 7 FROM dev)"
UNITED = {
    "aged": f"""SELECT *, CASE WHEN old < 1 THEN weight WHEN month({AS_OF}) IN (11, 12) THEN round(greatest(weight * power(CAST(0.975 AS DOUBLE), old), 0.40), 6)
        ELSE round(weight * power(CAST(0.95 AS DOUBLE), old), 6) END AS w FROM (SELECT *, date_diff('day', last_updated, {AS_OF}) AS old FROM ed) WHERE last_updated <= {AS_OF}""",
    "infer": f"""SELECT * FROM (SELECT {_NID['source']} AS src, {_NID['target']} AS dst, 'INFERRED' AS rel_type, w AS strength, frequency, confidence, last_updated AS valid_from,
        CAST(last_updated + CAST(floor(ln(0.1 / weight) / ln(0.95)) + 1 AS INTEGER) AS DATE) AS valid_to FROM aged WHERE w >= 0.1)
        WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes)""",
    "united": """SELECT src, dst, rel_type, strength, frequency, confidence FROM edges UNION ALL SELECT src, dst, rel_type, strength, frequency, confidence FROM infer""",
    "uadj": """SELECT src, dst, rel_type, strength, frequency, confidence FROM united UNION ALL SELECT dst, src, rel_type, strength, frequency, confidence FROM united""",
}


def united_query(name, run, sql, **views):
    """Register a query over the nodes and the observed and inferred edges together, as they stand a week after the newest event."""
    def call(spark, sf_dir):
        n, e = B.load_graph(spark, sf_dir)
        as_of = F.date_add(load_events(spark, sf_dir).agg(F.max("ts")).scalar(), 7)
        return run(n, B.united_edges(e, B.inferred_edges(load_edges(spark, sf_dir), n, as_of)))

    register(name, call, with_views(sql, **{**V.GRAPH, **EVENT_VIEWS, **INFERRED, **UNITED, **views}))


united_query("bfs", lambda n, e: reached(n, e, "Supplier", 3).select("node_id", "label", "depth", "trust"), _OUT, **reach_views("Supplier", 3, "uadj"))
united_query(
    "united_relationships",
    lambda n, e: G.orient(e.select("src", "dst", "rel_type", "strength", "confidence", "frequency", "valid_from", "valid_to")).where(F.col("rel_type") == B.INFERRED).join(
        n.select(F.col("node_id").alias("dst"), "label", "name"), "dst").select("src", "dst", "label", "name", r(F.col("strength")).alias("strength"), "confidence", "frequency", "valid_from", "valid_to"),
    """SELECT a.src, a.dst, label, name, round(strength, 6) AS strength, confidence, frequency, valid_from, valid_to
       FROM (SELECT * FROM infer UNION ALL SELECT dst, src, rel_type, strength, frequency, confidence, valid_from, valid_to FROM infer) a JOIN nodes ON dst = node_id""",
)


def opened_paths(n, e):
    """What inferred edges add: nodes nearer to a supplier with them than by observed edges alone, within three steps."""
    me = n.where("label = 'Supplier'").join(e.where(F.col("rel_type") == B.INFERRED).select(F.col("src").alias("node_id")), "node_id", "left_semi").agg(F.min("node_id").alias("node_id"))
    seen = G.reach(G.orient(e.where(F.col("rel_type") != B.INFERRED)), me, 3).select("node_id", F.col("depth").alias("observed_depth"))
    both = G.reach(G.orient(e), me, 3).select("node_id", "depth", "trust")
    d = both.join(seen, "node_id", "left").where(F.col("observed_depth").isNull() | (F.col("depth") < F.col("observed_depth")))
    return d.join(n, "node_id").select("node_id", "label", "depth", "trust", "observed_depth")


_ME = "SELECT min(node_id) AS node_id, 0 AS depth, CAST(1 AS DOUBLE) AS trust FROM nodes WHERE label = 'Supplier' AND node_id IN (SELECT src FROM infer)"
united_query(
    "opened_paths", opened_paths,
    """SELECT node_id, label, b.depth, b.trust, o.depth AS observed_depth FROM bo b LEFT JOIN ob o USING (node_id) JOIN nodes USING (node_id)
       WHERE o.depth IS NULL OR b.depth < o.depth""",
    **{**reach_views("Supplier", 3, "uadj", "bo"), "bo0": _ME}, **{**reach_views("Supplier", 3, "adj", "ob"), "ob0": _ME},
)
graph_query(
    "dfs_deepest_first",
    lambda n, e: reached(n, e, "Product", 3).select("node_id", "label", "depth").orderBy(F.desc("depth"), "node_id").limit(100),
    "SELECT node_id, label, depth FROM rch JOIN nodes USING (node_id) WHERE depth > 0 ORDER BY depth DESC, node_id LIMIT 100",
    **reach_views("Product", 3),
)
graph_query(
    "multi_hop_directed",
    lambda n, e: reached(n, e, "Product", 3, "in").select("node_id", "label", "depth", F.lit("upstream").alias("direction")).unionByName(
        reached(n, e, "Product", 3, "out").select("node_id", "label", "depth", F.lit("downstream").alias("direction"))),
    """SELECT node_id, label, depth, 'upstream' AS direction FROM up JOIN nodes USING (node_id) WHERE depth > 0
       UNION ALL SELECT node_id, label, depth, 'downstream' FROM down JOIN nodes USING (node_id) WHERE depth > 0""",
    turned=INTO, **reach_views("Product", 3, "turned", "up"), **reach_views("Product", 3, "edges", "down"),
)
graph_query(
    "k_hop", lambda n, e: G.k_hop(G.orient(e), pick(n, "Customer"), 2).join(n, "node_id").select("node_id", "label"),
    f"""SELECT DISTINCT n.node_id, label FROM adj a JOIN adj b ON b.src = a.dst JOIN nodes n ON n.node_id = b.dst
        WHERE a.src = {PICK.format('Customer')} AND b.dst <> a.src""",
)


def path_views(label: str, hops: int) -> dict[str, str]:
    views = {"p0": f"SELECT min(node_id) AS node_id, [min(node_id)] AS path FROM nodes WHERE label = '{label}'",
             "pairs": "SELECT DISTINCT src, dst FROM adj"}
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT node_id FROM p{i}" for i in range(k))
        views[f"p{k}"] = f"""SELECT dst AS node_id, list_append(min(path), dst) AS path FROM p{k - 1} JOIN pairs ON src = node_id
            WHERE dst NOT IN ({seen}) GROUP BY dst"""
    views["paths"] = " UNION ALL ".join(f"SELECT node_id, {k} AS hops, path FROM p{k}" for k in range(hops + 1))
    return views


def joined(path):
    return F.array_join(path, ">")


graph_query(
    "shortest_path",
    lambda n, e: G.shortest_paths(G.orient(e), pick(n, "Supplier"), 4).join(n.where("label = 'Customer'"), "node_id").select(
        "node_id", "hops", joined("path").alias("path")),
    """SELECT node_id, hops, array_to_string(path, '>') AS path FROM paths JOIN nodes USING (node_id) WHERE label = 'Customer'""",
    **path_views("Supplier", 4),
)


def weighted_views(label: str, hops: int) -> dict[str, str]:
    views = {"w0": f"SELECT min(node_id) AS node_id, CAST(0 AS DOUBLE) AS cost, [min(node_id)] AS path FROM nodes WHERE label = '{label}'",
             "hop": "SELECT src, dst, 1 / max(strength) AS w FROM adj WHERE strength > 0 GROUP BY src, dst"}
    for k in range(1, hops + 1):
        views[f"w{k}"] = f"""SELECT node_id, cost, path FROM (SELECT * FROM w{k - 1} UNION ALL
            SELECT dst, cost + w, list_append(path, dst) FROM w{k - 1} JOIN hop ON src = node_id)
            QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY cost, path) = 1"""
    return views


graph_query(
    "weighted_shortest_path",
    lambda n, e: G.weighted_paths(G.orient(e), pick(n, "Product"), 4).join(n.where("label IN ('Supplier', 'Shipment')"), "node_id").select(
        "node_id", "label", r(F.col("cost")).alias("cost"), joined("path").alias("path")),
    """SELECT node_id, label, round(cost, 6) AS cost, array_to_string(path, '>') AS path FROM w4 JOIN nodes USING (node_id)
       WHERE label IN ('Supplier', 'Shipment')""",
    **weighted_views("Product", 4),
)
graph_query(
    "pagerank",
    lambda n, e: G.pagerank(n, e).join(n, "node_id").select("node_id", "label", "name", r(F.col("rank")).alias("pagerank")).orderBy(
        F.desc("pagerank"), "node_id").limit(20),
    "SELECT node_id, label, name, round(pr, 6) AS pagerank FROM r3 JOIN nodes USING (node_id) ORDER BY pagerank DESC, node_id LIMIT 20",
    o="SELECT src, count(*) AS n_out FROM edges GROUP BY src",
    r0="SELECT node_id, 1 / (SELECT count(*) FROM nodes) AS pr FROM nodes",
    **{f"r{k}": f"""SELECT node_id, coalesce(got, 0) * CAST(0.85 AS DOUBLE) + (1 - CAST(0.85 AS DOUBLE)) AS pr FROM nodes LEFT JOIN (
        SELECT dst AS node_id, sum(pr / n_out) AS got FROM edges JOIN r{k - 1} ON edges.src = r{k - 1}.node_id JOIN o ON o.src = edges.src
        GROUP BY dst) USING (node_id)""" for k in (1, 2, 3)},
)


def part_of_graph(n, e):
    """Components left when product and order-to-shipment links are taken away."""
    e = e.where("rel_type IN ('STORED_IN', 'DELIVERED_TO', 'SUPPLIES')")
    c = G.connected_components(n.where("label <> 'Order'"), e)
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


_ROUNDS = 8
graph_query(
    "connected_components", lambda n, e: G.connected_components(n, e).groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes")),
    "SELECT component, count(*) AS n_nodes FROM w8 GROUP BY component", w0="SELECT node_id, node_id AS component FROM nodes",
    **{f"w{k}": f"""SELECT node_id, least(component, coalesce(m, component)) AS component FROM w{k - 1} LEFT JOIN (
        SELECT src AS node_id, min(component) AS m FROM adj JOIN w{k - 1} ON dst = node_id GROUP BY src) USING (node_id)""" for k in range(1, 9)},
)
graph_query(
    "connected_components_part", part_of_graph,
    f"SELECT component, count(*) AS n_nodes FROM c{_ROUNDS} GROUP BY component",
    cn="SELECT node_id FROM nodes WHERE label <> 'Order'",
    ca="SELECT src, dst FROM adj WHERE rel_type IN ('STORED_IN', 'DELIVERED_TO', 'SUPPLIES')",
    c0="SELECT node_id, node_id AS component FROM cn",
    **{f"c{k}": f"""SELECT node_id, least(component, coalesce(m, component)) AS component FROM c{k - 1} LEFT JOIN (
        SELECT src AS node_id, min(component) AS m FROM ca JOIN c{k - 1} ON dst = node_id GROUP BY src) USING (node_id)"""
       for k in range(1, _ROUNDS + 1)},
)


def ego_subgraph(n, e):
    """Centre and nodes within two hops by label with their mean and largest risk."""
    d = G.reach(G.orient(e), pick(n, "Supplier"), 2).join(n, "node_id")
    return d.groupBy("label", "depth").agg(F.count(F.lit(1)).alias("n_nodes"), r(F.avg("risk")).alias("avg_risk"), r(F.max("risk")).alias("max_risk"))


graph_query(
    "ego_subgraph", ego_subgraph,
    """SELECT label, depth, count(*) AS n_nodes, round(avg(risk), 6) AS avg_risk, round(max(risk), 6) AS max_risk
       FROM rch JOIN nodes USING (node_id) GROUP BY label, depth""",
    **reach_views("Supplier", 2),
)
graph_query(
    "risk_neighborhood",
    lambda n, e: reached(n, e, "Product", 2).where("risk >= 0.5").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_nodes"), r(F.avg("risk")).alias("avg_risk"), r(F.max("risk")).alias("max_risk")),
    """SELECT label, count(*) AS n_nodes, round(avg(risk), 6) AS avg_risk, round(max(risk), 6) AS max_risk
       FROM rch JOIN nodes USING (node_id) WHERE depth > 0 AND risk >= 0.5 GROUP BY label""",
    **reach_views("Product", 2),
)
_SHARE = "power(CAST(0.7 AS DOUBLE), depth)"
graph_query(
    "propagate_impact", lambda n, e: S.propagate_impact(n, e, pick(n, "Supplier"), 3),
    f"""SELECT node_id, label, depth, round({_SHARE}, 6) AS risk_contribution, {RISK.format(c=_SHARE)} AS risk_level
        FROM rch JOIN nodes USING (node_id) WHERE depth > 0""",
    **reach_views("Supplier", 3),
)
graph_query(
    "dependency_rank", lambda n, e: S.dependency_rank(n, e, pick(n, "Product"), 3),
    """SELECT node_id, label, direction, depth AS distance,
         round((risk * CAST(0.4 AS DOUBLE) + least(degree / 15, 1.0) * CAST(0.3 AS DOUBLE) + 1 / (1 + depth * CAST(0.3 AS DOUBLE)) * CAST(0.3 AS DOUBLE))
           * CASE WHEN direction = 'parent' THEN CAST(1.2 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END, 6) AS score,
         CASE WHEN least(degree / 15, 1.0) > 0.6 AND risk > 0.3 THEN 1 ELSE 0 END AS is_bottleneck,
         CASE WHEN risk > 0.5 AND depth <= 2 THEN 1 ELSE 0 END AS is_critical
       FROM (SELECT *, 'parent' AS direction FROM up UNION ALL SELECT *, 'child' FROM down) JOIN nodes USING (node_id) JOIN deg USING (node_id)
       WHERE depth > 0 ORDER BY score DESC, node_id, direction LIMIT 15""",
    turned=INTO, **reach_views("Product", 3, "turned", "up"), **reach_views("Product", 3, "edges", "down"),
)


def chain_views(label: str, hops: int, top: int = 10) -> dict[str, str]:
    views = {"back": "SELECT DISTINCT dst AS src, src AS dst FROM edges",
             "k0": f"SELECT node_id, risk AS total, [node_id] AS path FROM nodes WHERE node_id = {PICK.format(label)}"}
    for k in range(1, hops + 1):
        views[f"k{k}"] = f"""SELECT n.node_id, total + risk AS total, list_append(path, n.node_id) AS path FROM (
            SELECT dst, total, path FROM k{k - 1} JOIN back ON src = node_id
            QUALIFY row_number() OVER (PARTITION BY dst ORDER BY total DESC, path DESC) = 1) b JOIN nodes n ON n.node_id = b.dst"""
    rows = " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, hops + 1))
    views["chains"] = f"""SELECT total, path, array_to_string(path, '>') AS chain_id FROM (
        SELECT total, list_reverse(path) AS path FROM ({rows}) c JOIN nodes USING (node_id) WHERE risk > 0.2)
        ORDER BY total DESC, path DESC LIMIT {top}"""
    views["cn"] = """SELECT chain_id, position, n.node_id, label, risk FROM (SELECT chain_id, unnest(path) AS node_id,
        unnest(range(len(path))) AS position FROM chains) x JOIN nodes n ON n.node_id = x.node_id"""
    return views


def chained(run):
    return lambda n, e: run(S.chains(n, e, pick(n, "Product"), 4), n)


graph_query("critical_path", chained(lambda c, n: c.select("chain_id", r(F.col("total")).alias("path_risk"), (F.size("path") - 1).alias("hops"))),
            "SELECT chain_id, round(total, 6) AS path_risk, CAST(len(path) - 1 AS INTEGER) AS hops FROM chains", **chain_views("Product", 4))
graph_query(
    "causal_chain_confidence", chained(S.chain_confidence),
    """SELECT chain_id, round(avg(least(risk * power(CAST(0.7 AS DOUBLE), position) + CAST(0.2 AS DOUBLE), 1.0)), 6) AS confidence,
       count(*) AS chain_length, arg_min(node_id, position) AS root_cause, arg_min(risk, position) AS root_risk FROM cn GROUP BY chain_id""",
    **chain_views("Product", 4),
)
graph_query(
    "recommend_path", chained(S.recommend_path),
    """SELECT chain_id, round(avg(risk), 6) AS avg_risk, round(max(risk), 6) AS max_risk, count(*) AS length,
       first(node_id ORDER BY risk DESC, position) AS bottleneck, round(avg(risk) / count(*), 6) AS path_score
       FROM cn GROUP BY chain_id ORDER BY path_score DESC, chain_id DESC LIMIT 1""",
    **chain_views("Product", 4),
)


def affected_entities(n, e):
    """Distinct entities touched by chains, contributors (two hops) and dependencies, by source."""
    me = pick(n, "Product")
    parts = (
        S.chain_nodes(S.chains(n, e, me, 4), n).select("node_id", "label"),
        G.reach(G.orient(e), me, 1).where("depth > 0").join(n.where("label <> 'Order'"), "node_id").select("node_id", "label"),
        S.dependency_rank(n, e, me, 3).select("node_id", "label"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().where("label IN ('Supplier', 'Product', 'Warehouse')")


graph_query(
    "affected_entities", affected_entities,
    f"""SELECT DISTINCT node_id, label FROM (
          SELECT node_id, label FROM cn
          UNION ALL SELECT node_id, label FROM adj JOIN nodes ON dst = node_id WHERE src = {PICK.format('Product')} AND label <> 'Order'
          UNION ALL (SELECT node_id, label FROM (SELECT node_id, label, direction, round((risk * CAST(0.4 AS DOUBLE)
             + least(degree / 15, 1.0) * CAST(0.3 AS DOUBLE) + 1 / (1 + depth * CAST(0.3 AS DOUBLE)) * CAST(0.3 AS DOUBLE))
             * CASE WHEN direction = 'parent' THEN CAST(1.2 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END, 6) AS score
            FROM (SELECT *, 'parent' AS direction FROM up UNION ALL SELECT *, 'child' FROM down) JOIN nodes USING (node_id) JOIN deg USING (node_id)
            WHERE depth > 0 ORDER BY score DESC, node_id, direction LIMIT 15)))
        WHERE label IN ('Supplier', 'Product', 'Warehouse')""",
    turned=INTO, **chain_views("Product", 4), **reach_views("Product", 3, "turned", "up"), **reach_views("Product", 3, "edges", "down"),
)


def supply_chain_map(n, e):
    """Suppliers upstream, customers downstream and logistics around an order."""
    me = n.where("label = 'Order'").agg(F.min("node_id").alias("node_id"))
    make = lambda d, labels, part: d.where("depth > 0").join(n.where(F.col("label").isin(*labels)), "node_id").select(
        "node_id", "label", "depth", F.lit(part).alias("part"))
    moves = e.where("rel_type IN ('STORED_IN', 'SHIPS_VIA')")
    return (
        make(G.reach(G.orient(e, "in"), me, 3), ["Customer"], "upstream")
        .unionByName(make(G.reach(G.orient(e, "out"), me, 3), ["Customer", "Product"], "downstream"))
        .unionByName(make(G.reach(G.orient(moves), me, 2), ["Warehouse", "Shipment"], "logistics"))
    )


graph_query(
    "supply_chain_map", supply_chain_map,
    """SELECT node_id, label, depth, 'upstream' AS part FROM up JOIN nodes USING (node_id) WHERE depth > 0 AND label = 'Customer'
       UNION ALL SELECT node_id, label, depth, 'downstream' FROM down JOIN nodes USING (node_id) WHERE depth > 0 AND label IN ('Customer', 'Product')
       UNION ALL SELECT node_id, label, depth, 'logistics' FROM log JOIN nodes USING (node_id) WHERE depth > 0 AND label IN ('Warehouse', 'Shipment')""",
    turned=INTO, moves="SELECT * FROM adj WHERE rel_type IN ('STORED_IN', 'SHIPS_VIA')",
    **reach_views("Order", 3, "turned", "up"), **reach_views("Order", 3, "edges", "down"), **reach_views("Order", 2, "moves", "log"),
)
graph_query(
    "relationship_weight_tiers",
    lambda n, e: S.relationship_weights(e, pick(n, "Product"), n.select("node_id", "label")),
    f"""SELECT n.node_id, label, coalesce(direct, CASE WHEN depth = 2 THEN CAST(0.3 AS DOUBLE) END, CAST(0.1 AS DOUBLE)) AS rel_weight
        FROM nodes n LEFT JOIN (SELECT dst AS node_id, max(strength) AS direct FROM adj WHERE src = {PICK.format('Product')} GROUP BY dst) d
          ON d.node_id = n.node_id LEFT JOIN rch ON rch.node_id = n.node_id""",
    **reach_views("Product", 2),
)


def issue_context(n, e):
    """Neighbours within two hops of the types an issue looks at, sorted by that issue's metric."""
    me = pick(n, "Supplier")
    issues = (("late_delivery", ("SHIPS_VIA", "STORED_IN", "SUPPLIES"), ("Shipment", "Warehouse")),
              ("supplier_failure", ("SUPPLIES",), ("Supplier",)),
              ("inventory_stress", ("STORED_IN", "SUPPLIES"), ("Warehouse",)))
    out = None
    for issue, rels, labels in issues:
        d = G.reach(G.orient(e.where(F.col("rel_type").isin(*rels))), me, 2).where("depth > 0").join(
            n.where(F.col("label").isin(*labels)), "node_id")
        d = d.orderBy(F.desc("risk"), "node_id").limit(10).select(F.lit(issue).alias("issue"), "node_id", "label", r(F.col("risk")).alias("risk"))
        out = d if out is None else out.unionByName(d)
    return out


_ISSUE = "(SELECT '{i}' AS issue, node_id, label, round(risk, 6) AS risk FROM {v} JOIN nodes USING (node_id) WHERE depth > 0 AND label IN ({l}) ORDER BY risk DESC, node_id LIMIT 10)"
_ON = "SELECT * FROM adj WHERE rel_type IN ({})"
graph_query(
    "issue_context", issue_context,
    " UNION ALL ".join((_ISSUE.format(i="late_delivery", v="la", l="'Shipment', 'Warehouse'"), _ISSUE.format(i="supplier_failure", v="su", l="'Supplier'"),
                        _ISSUE.format(i="inventory_stress", v="iv", l="'Warehouse'"))),
    la_adj=_ON.format("'SHIPS_VIA', 'STORED_IN', 'SUPPLIES'"), su_adj=_ON.format("'SUPPLIES'"), iv_adj=_ON.format("'STORED_IN', 'SUPPLIES'"),
    **reach_views("Supplier", 2, "la_adj", "la"), **reach_views("Supplier", 2, "su_adj", "su"), **reach_views("Supplier", 2, "iv_adj", "iv"),
)
graph_query(
    "graph_version_diff",
    lambda n, e: version_diff(n, e.where("rel_type NOT IN ('STORED_IN', 'DELIVERED_TO')"), n, e),
    """, a AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges WHERE rel_type NOT IN ('STORED_IN', 'DELIVERED_TO')) AS e),
       b AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)
       SELECT b.n - a.n AS node_growth, b.e - a.e AS edge_growth,
         round(b.e / (b.n * (b.n - 1)) - a.e / (a.n * (a.n - 1)), 12) AS density_change FROM a, b""",
)


def version_diff(n1, e1, n2, e2):
    """Growth of nodes, edges and density from one snapshot to another."""
    count = lambda d: d.agg(F.count(F.lit(1))).scalar()
    row = n1.sparkSession.range(1).select(count(n1).alias("n1"), count(e1).alias("e1"), count(n2).alias("n2"), count(e2).alias("e2"))
    density = lambda n, e: F.col(e) / (F.col(n) * (F.col(n) - 1))
    return row.select((F.col("n2") - F.col("n1")).alias("node_growth"), (F.col("e2") - F.col("e1")).alias("edge_growth"),
                      F.round(density("n2", "e2") - density("n1", "e1"), 12).alias("density_change"))


def risk_factors(spark, sf_dir):
    """Risk figures of the nodes above 0.25 as labelled rows: what each kind of node is measured by, and how connected it is."""
    n, e = B.load_graph(spark, sf_dir)
    d = B.named(order_lines(spark, sf_dir, *GRAPH_COLUMNS, "first_line"))
    figures = (
        (B.extract_suppliers(d), {"overall_risk": "risk_score", "late_delivery": "delay_rate", "supplier_delay": "delay_rate"}),
        (B.extract_products(d), {"forecast_risk": "forecast_risk", "inventory_stress": "inventory_stress", "demand_volatility": "volatility"}),
        (B.extract_warehouses(d), {"warehouse_risk": "risk", "inventory_stress": "stress"}), (B.extract_shipments(d), {"late_delivery": "late_rate"}),
        (B.extract_orders(d), {"overall_risk": "risk_score"}),
        (n.join(G.degrees(e), "node_id").withColumn("c", F.least(F.col("degree") / 15, F.lit(1.0))), {"connectivity": "c"}),
    )
    out = None
    for table, names in figures:
        rows = table.select("node_id", F.explode(F.array(*[F.struct(F.lit(k).alias("factor"), F.col(c).cast("double").alias("value")) for k, c in names.items()])).alias("x")).select("node_id", "x.*")
        out = rows if out is None else out.unionByName(rows)
    return out.where("value > 0.25").select("node_id", "factor", r(F.col("value")).alias("value"), risk_label("value").alias("level"))


_FACTORS = " UNION ALL ".join(f"SELECT node_id, '{k}' AS factor, CAST({c} AS DOUBLE) AS v FROM {t}" for t, k, c in (
    ("sup", "overall_risk", "risk_score"), ("sup", "late_delivery", "delay_rate"), ("sup", "supplier_delay", "delay_rate"), ("pro", "forecast_risk", "forecast_risk"),
    ("pro", "inventory_stress", "inventory_stress"), ("pro", "demand_volatility", "volatility"), ("war", "warehouse_risk", "risk"), ("war", "inventory_stress", "stress"),
    ("shi", "late_delivery", "late_rate"), ("ord", "overall_risk", "risk_score"), ("deg JOIN nodes USING (node_id)", "connectivity", "least(degree / 15, 1.0)")))
register("risk_factors", risk_factors, with_views(f"SELECT node_id, factor, round(v, 6) AS value, {RISK.format(c='v')} AS level FROM f WHERE v > 0.25", **{**V.GRAPH, "f": _FACTORS}))
