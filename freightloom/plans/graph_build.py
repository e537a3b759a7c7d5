"""Node and edge extraction and the one-shot graph aggregates."""

from pyspark.sql import functions as F

from freightloom.operators import graph_build as B
from freightloom.operators import graph_walk as G
from freightloom.operators.analytics import r
from freightloom.plans import graph_views as V
from freightloom.plans.registry import over_items, over_lines, register, with_views

ALL = ("order_id line_no order_date days_real days_sched late department category ship_mode region city customer_id "
       "segment qty sales profit product_id supplier_id l_shipdate period")


def over_named(name, run, sql, columns=ALL, **views):
    over_items(name, lambda d: run(B.named(d)), columns, sql, **{**V.BASE, **views})


def over_named_lines(name, run, sql, columns=ALL, **views):
    over_lines(name, lambda d: run(B.named(d)), columns, sql, **{**V.BASE, **views})


def graph_query(name, run, sql=None, **views):
    """Register a query over the stored node and edge tables."""
    register(name, lambda spark, sf_dir: run(*B.load_graph(spark, sf_dir)), None if sql is None else with_views(sql, **{**V.GRAPH, **views}))


over_named("extract_suppliers", B.extract_suppliers, V.SUPPLIERS)
over_named("extract_products", B.extract_products, V.PRODUCTS)
over_named("extract_warehouses", B.extract_warehouses, V.WAREHOUSES)
over_named("extract_shipments", B.extract_shipments, V.SHIPMENTS)
over_named("extract_customers", B.extract_customers, V.CUSTOMERS)
over_named("extract_orders", B.extract_orders, V.ORDERS)
over_named("extract_orders_recent", lambda d: B.extract_orders(d, "recent"),
           V.ORDERS + " WHERE order_date >= (SELECT max(order_date) FROM fl) - 180")
over_named(
    "extract_orders_stratified", lambda d: B.extract_orders(d, "stratified"),
    V.ORDERS + """ QUALIFY row_number() OVER (PARTITION BY strftime(order_date, '%Y-%m') ORDER BY md5(order_id || '|42'))
      <= greatest(1, 5000 // (SELECT count(DISTINCT strftime(order_date, '%Y-%m')) FROM fl))""",
)
over_named("extract_calendar", B.extract_calendar, V.CALENDAR)
over_named("edges_supplies", B.edges_supplies, V.SUPPLIES)
over_named("edges_stored_in", B.edges_stored_in, V.STORED_IN)
over_named("edges_ships_via", B.edges_ships_via, V.SHIPS_VIA)
over_named("edges_delivered_to", B.edges_delivered_to, V.DELIVERED_TO)
over_named("edges_placed", B.edges_per_order, V.PER_ORDER)
for _rel in ("CONTAINS", "INFLUENCES"):
    over_named(f"edges_{_rel.lower()}", lambda d, rel=_rel: B.edges_per_order(d).where(F.col("rel_type") == rel),
               f"SELECT * FROM ({V.PER_ORDER}) WHERE rel_type = '{_rel}'")
graph_query(
    "entity_edge_extract", lambda n, e: B.entity_edges(e, n.where("label <> 'Order' OR risk > 0")).groupBy("rel_type").agg(
        F.count(F.lit(1)).alias("n")),
    """, ok AS (SELECT node_id FROM nodes WHERE label <> 'Order' OR risk > 0)
       SELECT rel_type, count(*) AS n FROM edges WHERE src IN (SELECT node_id FROM ok) AND dst IN (SELECT node_id FROM ok) GROUP BY rel_type""",
)


def degree_centrality(nodes, edges, label, top=10):
    d = nodes.where(F.col("label") == label).join(G.degrees(edges), "node_id", "left").select(
        "node_id", "name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    ).orderBy(F.desc("degree"), "node_id").limit(top)
    most = d.agg(F.greatest(F.max("degree"), F.lit(1))).scalar()
    return d.withColumn("centrality", r(F.col("degree") / most))


graph_query(
    "degree_centrality", lambda n, e: degree_centrality(n, e, "Supplier"),
    """, d AS (SELECT node_id, name, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (node_id) WHERE label = 'Supplier'
         ORDER BY degree DESC, node_id LIMIT 10)
       SELECT node_id, name, degree, round(degree / (SELECT greatest(max(degree), 1) FROM d), 6) AS centrality FROM d""",
)
graph_query(
    "top_connected",
    lambda n, e: n.join(G.degrees(e), "node_id").select("node_id", "label", "name", "degree").orderBy(F.desc("degree"), "node_id").limit(10),
    "SELECT node_id, label, name, degree FROM nodes JOIN deg USING (node_id) ORDER BY degree DESC, node_id LIMIT 10",
)


def graph_statistics(nodes, edges):
    """Counts by label and relation type plus totals and density, as (kind, key, value) rows."""
    n = nodes.groupBy(F.col("label").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    e = edges.groupBy(F.col("rel_type").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    nt, et = n.agg(F.sum("value")).scalar(), e.agg(F.sum("value")).scalar()
    spark = nodes.sparkSession
    total = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit("nodes").alias("key"), nt.alias("value")), F.struct(F.lit("edges").alias("key"), et.alias("value")),
        F.struct(F.lit("density").alias("key"), F.round(F.try_divide(et, nt * (nt - 1)), 9).alias("value")),
    )).alias("t")).select("t.*")
    return (
        n.withColumn("kind", F.lit("label")).unionByName(e.withColumn("kind", F.lit("relation")))
        .unionByName(total.withColumn("kind", F.lit("total")))
    )


graph_query(
    "graph_statistics", graph_statistics,
    """SELECT 'label' AS kind, label AS key, CAST(count(*) AS DOUBLE) AS value FROM nodes GROUP BY label
       UNION ALL SELECT 'relation', rel_type, count(*) FROM edges GROUP BY rel_type
       UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges
       UNION ALL SELECT 'total', 'density', round((SELECT count(*) FROM edges) / (count(*) * (count(*) - 1)), 9) FROM nodes""",
)


def graph_kpis(nodes, edges):
    g = nodes.select("node_id", "label").join(G.degrees(edges), "node_id", "left").groupBy("label").agg(
        F.count(F.lit(1)).alias("n_nodes"), r(F.avg(F.coalesce("degree", F.lit(0)))).alias("avg_degree"),
        F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
    )
    return g.withColumn("node_share", r(F.col("n_nodes") / g.agg(F.sum("n_nodes")).scalar()))


graph_query(
    "graph_kpis", graph_kpis,
    """SELECT label, count(*) AS n_nodes, round(avg(coalesce(degree, 0)), 6) AS avg_degree, coalesce(max(degree), 0) AS max_degree,
       round(count(*) / (SELECT count(*) FROM nodes), 6) AS node_share FROM nodes LEFT JOIN deg USING (node_id) GROUP BY label""",
)


def graph_validate(nodes, edges):
    """Issue rows: duplicate ids, orphans, unknown relation types, missing names, expected labels without nodes."""
    issue = lambda kind, level: (F.lit(kind).alias("issue"), F.lit(level).alias("level"))
    dup = nodes.groupBy("label", "node_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy(F.col("label").alias("key")).agg(
        F.count(F.lit(1)).alias("n"))
    touched = G.orient(edges.select("src", "dst")).select(F.col("src").alias("node_id")).distinct()
    orphan = nodes.join(touched, "node_id", "left_anti").groupBy(F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    unknown = edges.where(~F.col("rel_type").isin(*B.RELATIONS)).groupBy(F.col("rel_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    unnamed = nodes.where(F.coalesce(F.col("name"), F.lit("")) == "").groupBy(F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    have = nodes.select("label").distinct()
    expected = nodes.sparkSession.createDataFrame([(x,) for x in (*B.LABELS, "Region")], "label string")
    absent = expected.join(have, "label", "left_anti").select(F.col("label").alias("key"), F.lit(0).cast("long").alias("n"))
    out = None
    for part, kind, level in ((dup, "duplicate_node", "error"), (orphan, "orphan_node", "warning"), (unknown, "unknown_relation", "warning"),
                              (unnamed, "missing_name", "warning"), (absent, "missing_label", "info")):
        part = part.select(*issue(kind, level), "key", "n")
        out = part if out is None else out.unionByName(part)
    return out


def _damaged(n, e):
    hit = F.col("label").isin("Supplier", "Warehouse")
    n = n.withColumn("name", F.when((F.col("label") == "Shipment") & (F.col("risk") < 0.4), F.lit("")).otherwise(F.col("name")))
    return graph_validate(n.unionByName(n.where(hit & (F.col("risk") > 0.35))), e.where("rel_type <> 'INFLUENCES'").unionByName(
        e.where("rel_type = 'INFLUENCES'").withColumn("rel_type", F.lit("NUDGES"))))


graph_query(
    "graph_validate", _damaged,
    """, n0 AS (SELECT * REPLACE (CASE WHEN label = 'Shipment' AND risk < 0.4 THEN '' ELSE name END AS name) FROM nodes),
       n AS (SELECT * FROM n0 UNION ALL SELECT * FROM n0 WHERE label IN ('Supplier', 'Warehouse') AND risk > 0.35)
       SELECT 'duplicate_node' AS issue, 'error' AS level, label AS key, count(*) AS n FROM (SELECT label, node_id FROM n GROUP BY ALL HAVING count(*) > 1) GROUP BY label
       UNION ALL SELECT 'orphan_node', 'warning', label, count(*) FROM n WHERE node_id NOT IN (SELECT src FROM adj) GROUP BY label
       UNION ALL SELECT 'unknown_relation', 'warning', 'NUDGES', count(*) FROM edges WHERE rel_type = 'INFLUENCES'
       UNION ALL SELECT 'missing_name', 'warning', label, count(*) FROM n WHERE name = '' GROUP BY label
       UNION ALL SELECT 'missing_label', 'info', 'Region', 0""",
)


def pick(nodes, label):
    """The node of a label with the least id, the start of the traversal queries."""
    return nodes.where(F.col("label") == label).agg(F.min("node_id").alias("node_id"))


PICK = "(SELECT min(node_id) FROM nodes WHERE label = '{}')"


def topk_connected(nodes, edges, k=10):
    me = pick(nodes, "Product")
    d = G.orient(edges).join(me.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return d.select("dst", "rel_type", "strength", "frequency").orderBy(F.desc("strength"), F.desc("frequency"), "dst").limit(k)


graph_query(
    "topk_connected", topk_connected,
    f"""SELECT dst, rel_type, strength, frequency FROM adj WHERE src = {PICK.format('Product')}
        ORDER BY strength DESC, frequency DESC, dst LIMIT 10""",
)


def entity_with_connections(nodes, edges):
    """One row per connection of an entity, with its direction; a hub's connections stay separate rows."""
    me = pick(nodes, "Product").withColumnRenamed("node_id", "entity_id")
    out = edges.join(me, F.col("src") == F.col("entity_id")).select("entity_id", F.col("dst").alias("node_id"), F.lit("out").alias("direction"), "rel_type", "strength")
    into = edges.join(me, F.col("dst") == F.col("entity_id")).select("entity_id", F.col("src").alias("node_id"), F.lit("in").alias("direction"), "rel_type", "strength")
    return out.unionByName(into).join(nodes.select("node_id", "label", "name"), "node_id")


graph_query(
    "entity_with_connections", entity_with_connections,
    f"""SELECT entity_id, c.node_id, direction, rel_type, strength, label, name FROM (
          SELECT src AS entity_id, dst AS node_id, 'out' AS direction, rel_type, strength FROM edges WHERE src = {PICK.format('Product')}
          UNION ALL SELECT dst, src, 'in', rel_type, strength FROM edges WHERE dst = {PICK.format('Product')}) c JOIN nodes n ON n.node_id = c.node_id""",
)


def relationship_table(nodes, edges):
    me = pick(nodes, "Supplier")
    d = G.orient(edges).join(me.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return d.join(nodes.select(F.col("node_id").alias("dst"), "label", "name"), "dst").select(
        "dst", "label", "name", "rel_type", "strength", "confidence", "frequency")


graph_query(
    "relationship_table", relationship_table,
    f"""SELECT dst, label, name, rel_type, strength, confidence, frequency FROM adj JOIN nodes ON dst = node_id
        WHERE src = {PICK.format('Supplier')}""",
)


def critical_dependencies(nodes, edges, label="Supplier"):
    """Neighbours with at most two other connections, for every node of a label."""
    adj = G.orient(edges)
    own = adj.join(nodes.where(F.col("label") == label).select(F.col("node_id").alias("src")), "src", "left_semi").select(
        F.col("src").alias("target_id"), F.col("dst").alias("node_id"), "rel_type", "strength")
    n_near = adj.groupBy(F.col("src").alias("node_id")).agg(F.count_distinct("dst").alias("near"))
    alt = F.col("near") - 1  # every neighbour counts the target itself once
    d = own.join(n_near, "node_id").where(alt <= 2)
    kind = F.when(alt == 0, "sole_dependency").when(alt == 1, "near_sole_dependency").otherwise("limited_alternatives")
    return d.select("target_id", "node_id", "rel_type", "strength", alt.alias("alternatives"), kind.alias("criticality"))


graph_query(
    "critical_dependencies", lambda n, e: critical_dependencies(n, e, "Product"),
    """, near AS (SELECT src AS node_id, count(DISTINCT dst) - 1 AS alt FROM adj GROUP BY src)
       SELECT src AS target_id, node_id, rel_type, strength, alt AS alternatives,
         CASE alt WHEN 0 THEN 'sole_dependency' WHEN 1 THEN 'near_sole_dependency' ELSE 'limited_alternatives' END AS criticality
       FROM adj JOIN near ON dst = near.node_id WHERE alt <= 2 AND src IN (SELECT node_id FROM nodes WHERE label = 'Product')""",
)


def bottlenecks(nodes, edges):
    """Nodes with many connections but at most one distinct predecessor."""
    adj = G.orient(edges)
    c = adj.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.count_distinct("dst").alias("connections"))
    i = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count_distinct("src").alias("incoming"))
    d = c.join(i, "node_id", "left").select("node_id", "degree", "connections", F.coalesce("incoming", F.lit(0)).alias("incoming"))
    return nodes.join(d.where("degree >= 3 AND connections >= 3 AND incoming <= 1"), "node_id").select(
        "node_id", "label", "risk", "degree", "connections", "incoming")


graph_query(
    "bottlenecks", bottlenecks,
    """SELECT node_id, label, risk, degree, connections, coalesce(incoming, 0) AS incoming FROM nodes
       JOIN (SELECT src AS node_id, count(*) AS degree, count(DISTINCT dst) AS connections FROM adj GROUP BY src) USING (node_id)
       LEFT JOIN (SELECT dst AS node_id, count(DISTINCT src) AS incoming FROM edges GROUP BY dst) USING (node_id)
       WHERE degree >= 3 AND connections >= 3 AND coalesce(incoming, 0) <= 1""",
)


def rank_relationships(nodes, edges, top=10):
    me = pick(nodes, "Supplier").withColumnRenamed("node_id", "src")
    near = G.orient(edges).join(me, "src", "left_semi").select(F.col("dst").alias("node_id"), "rel_type", "strength")
    d = near.join(G.degrees(edges), "node_id").select(
        "node_id", "rel_type", "strength", F.col("degree").alias("neighbor_degree"),
        r(F.col("strength") * F.ln(F.col("degree") + 1.0)).alias("importance"))
    return d.orderBy(F.desc("importance"), "node_id").limit(top)


graph_query(
    "rank_relationships", rank_relationships,
    f"""SELECT node_id, rel_type, strength, degree AS neighbor_degree, round(strength * ln(degree + 1), 6) AS importance
        FROM adj JOIN deg ON dst = node_id WHERE src = {PICK.format('Supplier')} ORDER BY importance DESC, node_id LIMIT 10""",
)


def node_metrics(nodes, edges):
    d = G.orient(edges).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("strength").alias("w"))
    d = nodes.join(d, "node_id", "left")
    deg, w = F.coalesce("degree", F.lit(0)), F.coalesce("w", F.lit(0.0))
    return d.select("node_id", "label", deg.cast("long").alias("degree"), r(0.1 + deg * 0.15 + w * 0.05, 9).alias("centrality_score"),
                    r(0.2 + w * 0.1, 9).alias("dependency_score"), r(100.0 * (1 + F.col("risk") * 0.5), 9).alias("impact_score"))


graph_query(
    "node_metrics", node_metrics,
    """SELECT node_id, label, coalesce(n, 0) AS degree, round(0.1 + coalesce(n, 0) * CAST(0.15 AS DOUBLE) + coalesce(w, 0) * CAST(0.05 AS DOUBLE), 9) AS centrality_score,
       round(0.2 + coalesce(w, 0) * CAST(0.1 AS DOUBLE), 9) AS dependency_score, round(100 * (1 + risk * CAST(0.5 AS DOUBLE)), 9) AS impact_score
       FROM nodes LEFT JOIN (SELECT src AS node_id, count(*) AS n, sum(strength) AS w FROM adj GROUP BY src) USING (node_id)""",
)
