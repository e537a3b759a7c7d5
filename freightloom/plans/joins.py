"""Matching, enrichment, merging and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.operators import graph_build as B
from freightloom.operators.analytics import r
from freightloom.operators.forecasts import monthly_cells
from freightloom.operators.quality import dedup_keep_last
from freightloom.plans import graph_views as V
from freightloom.plans.evaluate import SCORED, load_scores
from freightloom.plans.graph_build import over_named
from freightloom.plans.patterns import BASE as EVENT_VIEWS
from freightloom.plans.patterns import COLS as EVENT_COLS
from freightloom.operators import patterns as P
from freightloom.plans.registry import over_items, register, with_views
from freightloom.plans.views import CELLS, RUNNING_SQL, running_month, since, since_sql

KEY = ["order_id", "line_no", "product_id", "supplier_id", "l_shipdate"]
KEYS = ", ".join(KEY)
NEW_MONTHS = 3  # rows of the newest month and the three before it count as newly arrived
CUT = since_sql(NEW_MONTHS)
_MATCH = "order_id line_no product_id supplier_id l_shipdate order_date department ship_mode region late qty"


def new_rows(d):
    return d.where(F.col("order_date") >= since(d, NEW_MONTHS))


def old_rows(d):
    return d.where(F.col("order_date") < since(d, NEW_MONTHS))


def anchors(history):
    """Forecast anchors (entity type, id, value) from the rows of the month before the cut."""
    keys = F.explode(F.array(
        F.struct(F.lit("Product").alias("t"), F.col("product_id").cast("string").alias("i"), F.col("qty").alias("v")),
        F.struct(F.lit("Supplier").alias("t"), F.col("department").alias("i"), F.col("late").cast("double").alias("v")),
        F.struct(F.lit("Route").alias("t"), F.concat_ws("|", "ship_mode", "region").alias("i"), F.col("late").cast("double").alias("v")),
    ))
    return history.select(keys.alias("k")).groupBy(F.col("k.t").alias("entity_type"), F.col("k.i").alias("entity_id")).agg(r(F.avg("k.v")).alias("predicted"))


def match_exact(rows, forecast):
    """Exact matches of rows to anchors of three kinds in one join: a row is looked up under each of its keys."""
    keys = F.explode(F.array(
        F.struct(F.lit("Product").alias("t"), F.col("product_id").cast("string").alias("i")),
        F.struct(F.lit("Supplier").alias("t"), F.col("department").alias("i")),
        F.struct(F.lit("Route").alias("t"), F.concat_ws("|", "ship_mode", "region").alias("i")),
    ))
    d = rows.withColumn("k", keys).select("*", F.col("k.t").alias("entity_type"), F.col("k.i").alias("entity_id")).drop("k")
    return d.join(forecast, ["entity_type", "entity_id"])


_UNION = """SELECT {c} 'Product' AS entity_type, CAST(product_id AS VARCHAR) AS entity_id, qty AS v FROM {t}
 UNION ALL SELECT {c} 'Supplier', department, late FROM {t} UNION ALL SELECT {c} 'Route', ship_mode || '|' || region, late FROM {t}"""
ANCHORS = {
    "hist": f"SELECT * FROM oi WHERE order_date < {CUT} AND order_date >= {since_sql(NEW_MONTHS + 1)}", "fresh": f"SELECT * FROM oi WHERE order_date >= {CUT}",
    "anc": f"SELECT entity_type, entity_id, round(avg(v), 6) AS predicted FROM ({_UNION.format(c='', t='hist')}) GROUP BY entity_type, entity_id",
    "mt": f"SELECT {KEYS}, entity_type, entity_id, predicted FROM ({_UNION.format(c=KEYS + ',', t='fresh')}) JOIN anc USING (entity_type, entity_id)",
}


def _matched(d):
    return match_exact(new_rows(d), anchors(old_rows(d).where(F.col("order_date") >= since(d, NEW_MONTHS + 1))))


over_items("match_forecast_exact", lambda d: _matched(d).select(*KEY, "entity_type", "entity_id", "predicted"), _MATCH, "SELECT * FROM mt", **ANCHORS)


def unmatched(d):
    """New rows without a forecast anchor of any kind; the anchors come from all rows before the cut."""
    return new_rows(d).join(match_exact(new_rows(d), anchors(old_rows(d))).select(*KEY).distinct(), KEY, "left_anti").select(*KEY)


over_items("except_unmatched", unmatched, _MATCH, f"SELECT {KEYS} FROM fresh EXCEPT ALL SELECT DISTINCT {KEYS} FROM mt", **{**ANCHORS, "hist": f"SELECT * FROM oi WHERE order_date < {CUT}"})


def compare_category_region(d):
    """Forecast cells (the mean of the last three complete months) against what the running month has uploaded; a cell without actuals gets an even share of the uploaded total."""
    running = running_month(d)
    first = F.date_format(F.add_months(F.to_date(F.concat(running, F.lit("-01"))), -3), "yyyy-MM")
    months = monthly_cells(d)
    cells = months.where((F.col("period") < running) & (F.col("period") >= first)).groupBy("category", "region").agg(F.avg("actual").alias("forecast"), F.count(F.lit(1)).alias("n")).where("n = 3")
    uploaded = months.where(F.col("period") == running).select("category", "region", "actual").join(cells, ["category", "region"], "left_semi")
    share = uploaded.agg(F.sum("actual")).scalar() / cells.agg(F.count(F.lit(1))).scalar()
    c = cells.select("category", "region", "forecast").join(uploaded, ["category", "region"], "left")
    act = F.coalesce("actual", share)
    return c.select("category", "region", r(F.col("forecast")).alias("forecast"), r(act).alias("actual"), F.col("actual").isNull().cast("int").alias("estimated"),
                    r((act - F.col("forecast")) / F.col("forecast") * 100, 4).alias("variance_pct"))


over_items(
    "compare_category_region", compare_category_region, "category region period qty late sales order_date",
    f""", c AS (SELECT category, region, avg(actual) AS forecast FROM cells WHERE period < {RUNNING_SQL}
           AND period >= (SELECT strftime(date_trunc('month', max(order_date) + INTERVAL 1 DAY) - INTERVAL 3 MONTH, '%Y-%m') FROM oi) GROUP BY category, region HAVING count(*) = 3),
         u AS (SELECT category, region, actual FROM cells SEMI JOIN c USING (category, region) WHERE period = {RUNNING_SQL})
       SELECT c.category, c.region, round(c.forecast, 6) AS forecast, round(a, 6) AS actual, CASE WHEN u.actual IS NULL THEN 1 ELSE 0 END AS estimated,
         round((a - c.forecast) / c.forecast * 100, 4) AS variance_pct
       FROM c LEFT JOIN u ON c.category = u.category AND c.region = u.region,
         LATERAL (SELECT coalesce(u.actual, (SELECT sum(actual) FROM u) / (SELECT count(*) FROM c)) AS a)""",
    cells=CELLS,
)


def route_delays(d):
    """Mean observed delay of the other routes that share the mode or the region, per route.

    Sums per mode and per region less the route itself give the neighbour mean without pairing routes.
    """
    g = d.groupBy("ship_mode", "region").agg(F.avg(F.col("days_real") - F.col("days_sched")).alias("own"))
    m, n = Window.partitionBy("ship_mode"), Window.partitionBy("region")
    total = F.sum("own").over(m) + F.sum("own").over(n) - 2 * F.col("own")
    count = F.count("own").over(m) + F.count("own").over(n) - 2
    return g.select("ship_mode", "region", r(F.col("own")).alias("own_delay"), r(F.try_divide(total, count)).alias("neighbour_delay"))


over_items(
    "neighbour_route_delay", route_delays, "ship_mode region days_real days_sched",
    """, g AS (SELECT ship_mode, region, avg(days_real - days_sched) AS own FROM oi GROUP BY ALL)
       SELECT a.ship_mode, a.region, round(any_value(a.own), 6) AS own_delay, round(avg(b.own), 6) AS neighbour_delay FROM g a JOIN g b
         ON (a.ship_mode = b.ship_mode) <> (a.region = b.region) GROUP BY a.ship_mode, a.region""",
)


def peer_blend(d):
    """0.7 own reliability plus 0.3 mean of the peers, the departments of the same risk band."""
    g = d.groupBy("department").agg((1 - F.avg("late")).alias("own")).withColumn("band", F.floor(F.col("own") * 50))
    peers = g.groupBy("band").agg(F.sum("own").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = F.try_divide(F.col("s") - F.col("own"), F.col("n") - 1)
    return g.join(peers, "band").select("department", r(F.coalesce(F.col("own") * 0.7 + mean * 0.3, F.col("own"))).alias("reliability"))


over_items(
    "peer_blend", peer_blend, "department late",
    """, g AS (SELECT department, 1 - avg(late) AS own FROM oi GROUP BY department)
       SELECT a.department, round(CASE WHEN avg(b.own) IS NULL THEN any_value(a.own) ELSE any_value(a.own) * CAST(0.7 AS DOUBLE) + avg(b.own) * CAST(0.3 AS DOUBLE) END, 6) AS reliability
       FROM g a LEFT JOIN g b ON floor(a.own * 50) = floor(b.own * 50) AND a.department <> b.department GROUP BY a.department""",
)


def enrich(s):
    """Graph features per row from three lookups; a miss keeps the value known from earlier rows."""
    sup = s.groupBy("department").agg((1 - F.avg("late")).alias("rel"))
    reg = s.groupBy("region").agg(F.avg(F.least(F.col("qty") / F.greatest("p_qty30", F.lit(1.0)), F.lit(3.0))).alias("stress"))
    route = route_delays(s).select("ship_mode", "region", F.col("neighbour_delay").alias("delay"))
    d = s.join(sup, "department", "left").join(reg, "region", "left").join(route, ["ship_mode", "region"], "left")
    return d.select(*KEY, r(F.coalesce("rel", 1 - F.col("p_sup"))).alias("graph_supplier_reliability"), r(F.coalesce("stress", F.lit(0.5))).alias("graph_inventory_stress"),
                    r(F.coalesce("delay", "p_route")).alias("graph_avg_shipping_delay"))


register(
    "enrich_lookup", lambda spark, sf_dir: enrich(load_scores(spark, sf_dir)),
    with_views(f"""SELECT {KEYS}, round(coalesce(rel, 1 - p_sup), 6) AS graph_supplier_reliability, round(stress, 6) AS graph_inventory_stress, delay AS graph_avg_shipping_delay
        FROM scored LEFT JOIN (SELECT department, 1 - avg(late) AS rel FROM oi GROUP BY department) USING (department)
        LEFT JOIN (SELECT region, avg(least(qty / greatest(p_qty30, 1.0), 3.0)) AS stress FROM scored GROUP BY region) USING (region)
        LEFT JOIN (SELECT a.ship_mode, a.region, round(avg(b.own), 6) AS delay FROM g a JOIN g b ON (a.ship_mode = b.ship_mode) <> (a.region = b.region)
          GROUP BY a.ship_mode, a.region) USING (ship_mode, region)""",
               scored=SCORED, g="SELECT ship_mode, region, avg(days_real - days_sched) AS own FROM oi GROUP BY ALL"),
)


def upsert(old, new, key):
    """Merge on the key; the newer properties win, and either side alone survives."""
    cols = [c for c in new.columns if c != key]
    d = old.alias("o").join(new.alias("n"), key, "full_outer")
    state = F.when(F.col(f"o.{cols[0]}").isNull(), "created").when(F.col(f"n.{cols[0]}").isNull(), "kept").otherwise("updated")
    return d.select(key, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in cols], state.alias("state"))


def node_upsert(d):
    return upsert(B.extract_customers(old_rows(d)), B.extract_customers(new_rows(d)), "node_id")


_CUS = V.CUSTOMERS.replace("FROM nm", "FROM {t}")
over_named(
    "node_upsert", node_upsert,
    """SELECT node_id, """ + ", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in ("customer_id", "segment", "region", "total_orders", "avg_order_value", "profit_margin")) + """,
       CASE WHEN o.customer_id IS NULL THEN 'created' WHEN n.customer_id IS NULL THEN 'kept' ELSE 'updated' END AS state FROM o FULL OUTER JOIN n USING (node_id)""",
    a=f"SELECT * FROM nm WHERE order_date < {CUT}", b=f"SELECT * FROM nm WHERE order_date >= {CUT}", o=_CUS.format(t="a"), n=_CUS.format(t="b"),
)


def merge_master(d):
    """Old and new rows, the last one per item winning; new rows restate the sales of old ones."""
    old = d.withColumn("seq", F.lit(0))
    new = new_rows(d).withColumns({"seq": F.lit(1), "sales": F.col("sales") * 2})
    order = ["seq", "l_shipdate", "product_id", "supplier_id"]
    return dedup_keep_last(old.unionByName(new), ["order_id", "line_no"], order).select("order_id", "line_no", "product_id", "sales", "seq")


over_items(
    "merge_master", merge_master, "order_id line_no product_id supplier_id l_shipdate order_date sales",
    f"""SELECT order_id, line_no, product_id, sales, seq FROM (SELECT *, 0 AS seq FROM oi UNION ALL SELECT * REPLACE (sales * 2 AS sales), 1 FROM oi WHERE order_date >= {CUT})
        QUALIFY row_number() OVER (PARTITION BY order_id, line_no ORDER BY seq DESC, l_shipdate DESC, product_id DESC, supplier_id DESC) = 1""",
)
# Points for a percent of risk cut and for a day saved, and points lost for a unit of cost.
RISK_POINTS, DAY_POINTS, COST_POINTS = 0.4, 15.0, 0.1


def scenario_scores(d):
    """What if a department sent everything by one shipping mode: every mode of the orders is a scenario, with the risk, lead time and unit cost its lines have had,
    scored against the department's own and ranked. Modes and departments are both read off the table."""
    figures = lambda key: d.groupBy(key).agg(F.avg("late").alias("risk"), F.avg("days_real").alias("lead"), F.try_divide(F.sum("sales"), F.sum("qty")).alias("cost"))
    modes = figures("ship_mode").agg(F.collect_list(F.struct("ship_mode", "risk", "lead", "cost"))).scalar()  # a handful of rows: the modes
    own = figures("department").withColumn("m", F.explode(modes))
    cut = F.greatest(F.try_divide(F.col("risk") - F.col("m.risk"), F.col("risk")) * 100, F.lit(0.0))
    score = cut * RISK_POINTS + F.greatest(F.col("lead") - F.col("m.lead"), F.lit(0.0)) * DAY_POINTS - (F.col("m.cost") - F.col("cost")) * COST_POINTS
    scored = own.select("department", F.col("m.ship_mode").alias("scenario"), r(F.coalesce(cut, F.lit(0.0))).alias("risk_reduction_pct"), r(F.coalesce(score, F.lit(0.0))).alias("score"))
    rank = F.row_number().over(Window.partitionBy("department").orderBy(F.desc("score"), "scenario"))
    return scored.withColumn("rank", rank)


over_items(
    "scenario_cross", scenario_scores, "department ship_mode late days_real sales qty",
    """, f AS (SELECT department, avg(late) AS risk, avg(days_real) AS lead, sum(sales) / sum(qty) AS cost FROM oi GROUP BY department),
       m AS (SELECT ship_mode, avg(late) AS mr, avg(days_real) AS ml, sum(sales) / sum(qty) AS mc FROM oi GROUP BY ship_mode)
       SELECT *, CAST(row_number() OVER (PARTITION BY department ORDER BY score DESC, scenario) AS INTEGER) AS rank FROM (
         SELECT department, scenario, round(cut, 6) AS risk_reduction_pct, round(cut * CAST(0.4 AS DOUBLE) + greatest(lead - ml, 0.0) * 15 - (mc - cost) * CAST(0.1 AS DOUBLE), 6) AS score
         FROM (SELECT *, ship_mode AS scenario, coalesce(greatest((risk - mr) / nullif(risk, 0) * 100, 0.0), 0.0) AS cut FROM f, m))""",
)
over_items(
    "union_history",
    lambda d: old_rows(d).select("order_id", "line_no", "qty").unionByName(
        new_rows(d).select("line_no", "order_id", "qty", "late"), allowMissingColumns=True),
    "order_id line_no qty late order_date",
    f"""SELECT order_id, line_no, qty, CAST(NULL AS INTEGER) AS late FROM oi WHERE order_date < {CUT} UNION ALL SELECT order_id, line_no, qty, late FROM oi WHERE order_date >= {CUT}""",
)
over_items("distinct_anchor_keys", lambda d: d.select("ship_mode", "region", "department").distinct(), "ship_mode region department",
           "SELECT DISTINCT ship_mode, region, department FROM oi")


def shared_keys(d):
    w = P.with_forecast(P.entity_weeks(d))
    return w.where("predicted IS NOT NULL").select("entity_id", "entity_type", "ts").intersect(w.where("actual > 0").select("entity_id", "entity_type", "ts"))


over_items(
    "intersect_entity_keys", shared_keys, EVENT_COLS,
    """SELECT entity_id, entity_type, ts FROM (SELECT *, count(actual) OVER (PARTITION BY entity_type, entity_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM weeks)
       WHERE c = 3 INTERSECT SELECT entity_id, entity_type, ts FROM weeks WHERE actual > 0""",
    **EVENT_VIEWS,
)
