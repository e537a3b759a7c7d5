"""Aggregations over the order lines and top-k reports."""

from pyspark.sql import functions as F

from freightloom.operators import analytics as A
from freightloom.operators.forecasts import matched_cells
from freightloom.plans.registry import over_items
from freightloom.plans.views import CELLS

_PERIOD_SQL = """
SELECT {key}, count(DISTINCT order_id) AS total_orders, count(*) AS total_rows, round(sum(sales), 2) AS total_sales,
  round(avg(profit), 4) AS avg_profit, CAST(sum(late) AS BIGINT) AS late_delivery_count,
  CAST(sum(qty) AS BIGINT) AS total_items, round(avg(days_real), 6) AS avg_shipping_days,
  round(avg(days_sched), 6) AS avg_scheduled_days,
  count(DISTINCT CASE WHEN late = 1 THEN order_id END) AS late_orders,
  round(sum(late) / count(DISTINCT order_id), 6) AS late_delivery_rate,
  round(sum(late) / count(*), 6) AS late_rate_rows,
  round(count(DISTINCT CASE WHEN late = 1 THEN order_id END) / count(DISTINCT order_id), 6) AS late_rate_orders
FROM oi GROUP BY {key}
"""
_PERIOD_COLS = "order_id order_date period sales profit late qty days_real days_sched"

over_items("monthly_agg", lambda d: A.period_table(d, "period"), _PERIOD_COLS, _PERIOD_SQL.format(key="period"))


def week_key(d):
    """Calendar year with ISO week, so early January can read as week 52 or 53 of the new year."""
    return F.concat(
        F.year("order_date").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("order_date").cast("string"), 2, "0")
    )


_WEEK_SQL = "(year(order_date) || '-W' || lpad(CAST(weekofyear(order_date) AS VARCHAR), 2, '0'))"
over_items(
    "weekly_agg",
    lambda d: A.period_table(d.withColumn("period_weekly", week_key(d)), "period_weekly"),
    _PERIOD_COLS,
    _PERIOD_SQL.format(key="period_weekly").replace("FROM oi", "FROM weekly"),
    weekly=f"SELECT *, {_WEEK_SQL} AS period_weekly FROM oi",
)
over_items(
    "mode_breakdown", A.mode_breakdown, "ship_mode late days_real days_sched",
    """SELECT ship_mode, count(*) AS order_count, round(avg(late), 6) AS late_rate,
       round(avg(days_real - days_sched), 6) AS avg_delay,
       round(count(*) / (SELECT count(*) FROM oi) * 100, 6) AS pct FROM oi GROUP BY ship_mode""",
)
over_items(
    "status_breakdown", A.status_breakdown, "status",
    """SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM oi) * 100, 6) AS pct
       FROM oi GROUP BY status""",
)
over_items(
    "supplier_reliability", A.supplier_reliability, "department late days_real days_sched",
    """, g AS (SELECT department, count(*) AS order_count, CAST(sum(late) AS BIGINT) AS late_count,
         1 - sum(late) / count(*) AS rel, avg(days_real - days_sched) AS delay FROM oi GROUP BY department)
       SELECT department, order_count, late_count, round(rel, 6) AS reliability, round(delay, 6) AS avg_delay,
         round((SELECT avg(rel) FROM g), 6) AS avg_reliability FROM g""",
)
over_items(
    "region_breakdown", lambda d: A.late_breakdown(d, "region"), "region late days_real days_sched",
    """SELECT region, count(*) AS order_count, round(avg(late), 6) AS late_rate,
       round(avg(days_real - days_sched), 6) AS avg_delay FROM oi GROUP BY region""",
)
over_items(
    "category_volatility", A.category_volatility, "category qty late",
    """SELECT category, round(least(greatest(stddev_samp(qty) / CASE WHEN avg(qty) = 0 THEN 1.0 ELSE avg(qty) END, 0.0), 1.0), 6) AS score,
       round(avg(late), 6) AS late_rate, count(*) AS order_count
       FROM oi GROUP BY category ORDER BY score DESC, category LIMIT 15""",
)
over_items(
    "value_brackets", A.value_brackets, "sales",
    """SELECT CASE WHEN sales < 50 THEN 'low' WHEN sales < 200 THEN 'medium' WHEN sales < 500 THEN 'high'
       ELSE 'premium' END AS bracket, count(*) AS n FROM oi WHERE sales IS NOT NULL GROUP BY 1""",
)
over_items(
    "risk_heatmap", A.risk_heatmap, "category region late days_real days_sched",
    """SELECT category, region, round(lr, 6) AS score, round(lr * 0.9, 6) AS demand_risk,
       round(lr * 0.85, 6) AS inventory_risk, round(lr * 1.05, 6) AS supplier_risk,
       round(least(dl / 3, 1.0), 6) AS logistics_risk, n AS order_count
       FROM (SELECT category, region, avg(late) AS lr, avg(days_real - days_sched) AS dl, count(*) AS n
             FROM oi GROUP BY category, region HAVING count(*) >= 20)
       ORDER BY score DESC, category, region LIMIT 100""",
)
over_items(
    "monthly_trend", A.monthly_trend, "period late days_real days_sched sales qty",
    """SELECT period, count(*) AS orders, CAST(sum(late) AS BIGINT) AS late_orders, round(avg(late), 6) AS late_rate,
       round(avg(days_real - days_sched), 6) AS avg_delay, round(sum(sales), 2) AS total_sales,
       CAST(sum(qty) AS BIGINT) AS total_qty FROM oi GROUP BY period""",
)
over_items(
    "global_kpis", A.global_kpis, "late days_real days_sched order_date",
    """SELECT count(*) AS total_orders, CAST(sum(late) AS BIGINT) AS late_count, round(avg(late) * 100, 6) AS late_pct,
       round(avg(days_real - days_sched), 6) AS avg_delay, min(order_date) AS date_min, max(order_date) AS date_max
       FROM oi""",
)

_ENTITY_RISK = """, g AS (SELECT {e} AS entity, count(*) AS n, sum(late) AS l, avg(days_real - days_sched) AS d, sum(sales) AS s
   FROM oi GROUP BY {e} ORDER BY n DESC, entity LIMIT 50),
 er AS (SELECT entity, n AS total_orders, CAST(l AS BIGINT) AS late_orders,
   round(greatest(least(l / n * 0.7 + least(d / 5, 1.0) * 0.3, 0.99), 0.01), 6) AS risk,
   round(greatest(least((1 - l / n * 0.35) * 100, 99.0), 50.0), 6) AS forecast_accuracy,
   round(greatest(d + 2.5, 0.5), 6) AS lead_time,
   round(greatest(least((1 - l / n) * 100, 100.0), 50.0), 6) AS sla,
   round(s, 2) AS total_sales,
   round(s * greatest(least(l / n * 0.7 + least(d / 5, 1.0) * 0.3, 0.99), 0.01), 2) AS business_impact FROM g)
"""
_ENTITY_COLS = "late days_real days_sched sales "
over_items(
    "entity_risk", lambda d: A.entity_risk(d, "department"), _ENTITY_COLS + "department",
    _ENTITY_RISK.format(e="department") + "SELECT * FROM er",
)
over_items(
    "normalized_weighted_risk", lambda d: A.normalized_weighted_risk(d, "city"), _ENTITY_COLS + "city",
    _ENTITY_RISK.format(e="city")
    + "SELECT entity, risk, round(risk / (SELECT sum(risk) FROM er) * 100, 6) AS normalized_risk FROM er",
)
over_items(
    "entity_kpis", lambda d: A.entity_kpis(d, "department"), _ENTITY_COLS + "department",
    """SELECT department AS entity, count(*) AS total_orders, round(avg(late) * 100, 6) AS risk_pct,
       round(100 - avg(late) * 100, 6) AS sla_pct,
       round(greatest(least(100 - avg(late) * 100 * 0.3, 98.5), 65.0), 6) AS forecast_accuracy_pct,
       round(sum(sales) * avg(late), 2) AS financial_exposure,
       round(greatest(avg(days_real - days_sched), 0.2), 6) AS lead_time_delay,
       round(sum(sales) * 0.15, 2) AS business_impact FROM oi GROUP BY department""",
)
over_items(
    "lead_time_anomaly", A.lead_time_anomaly, "period days_real days_sched",
    """, m AS (SELECT period, round(greatest(avg(days_real - days_sched) + 2.0, 0.5), 6) AS lead_time FROM oi GROUP BY period)
       SELECT period, lead_time, CASE WHEN lead_time > (SELECT avg(lead_time) + 1.5 * stddev_pop(lead_time) FROM m)
         THEN 1 ELSE 0 END AS is_anomaly FROM m""",
)


def _diagnostics(d):
    cells = matched_cells(d)
    last = cells.where("orders >= 5").agg(F.max("period")).scalar()
    return A.error_diagnostics(
        cells.where(F.col("period") == last).select(
            "category", "region", F.col("orders").alias("order_count"), F.col("forecast").alias("predicted_demand"),
            F.col("actual").alias("actual_demand"), "late_rate",
        )
    )


over_items(
    "error_diagnostics", _diagnostics, "category region period qty late sales",
    """SELECT category, region, orders AS order_count, round(forecast, 4) AS predicted_demand, actual AS actual_demand,
       round((actual - forecast) / (forecast + 1e-6) * 100, 6) AS variance_pct, round(late_rate, 6) AS late_rate,
       CASE WHEN late_rate >= 0.55 THEN 'high' WHEN late_rate >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN late_rate >= 0.55 THEN 'logistics' WHEN late_rate >= 0.35 THEN 'supplier' ELSE 'demand' END AS responsible
       FROM cells WHERE forecast IS NOT NULL AND orders >= 5
         AND period = (SELECT max(period) FROM cells WHERE forecast IS NOT NULL AND orders >= 5)
       ORDER BY orders DESC, category, region LIMIT 10""",
    cells=CELLS,
)


def _accuracy(d):
    dev = F.abs(F.col("actual") - F.col("forecast")) / F.col("actual") * 100
    m = matched_cells(d).where("actual > 0").select(dev.alias("dev"))
    return m.agg(
        A.r(F.avg("dev"), 4).alias("mape"),
        A.r(F.greatest(F.lit(0.0), 100 - F.avg("dev")), 4).alias("accuracy"),
        F.count_if(F.col("dev") < 10).alias("within_10"),
        F.count_if((F.col("dev") >= 10) & (F.col("dev") < 25)).alias("within_25"),
        F.count_if(F.col("dev") >= 25).alias("beyond_25"),
    )


over_items(
    "accuracy_bands", _accuracy, "category region period qty late sales",
    """, m AS (SELECT abs(actual - forecast) / actual * 100 AS dev FROM cells WHERE forecast IS NOT NULL AND actual > 0)
       SELECT round(avg(dev), 4) AS mape, round(greatest(0.0, 100 - avg(dev)), 4) AS accuracy,
       count(*) FILTER (dev < 10) AS within_10, count(*) FILTER (dev >= 10 AND dev < 25) AS within_25,
       count(*) FILTER (dev >= 25) AS beyond_25 FROM m""",
    cells=CELLS,
)
over_items(
    "incident_impact", lambda d: A.incident_impact(d, "department"), "department sales late order_id customer_id",
    """SELECT department, round(sum(sales) * avg(late) * 0.12, 2) AS estimated_loss,
       count(DISTINCT CASE WHEN late = 1 THEN order_id END) AS affected_orders,
       count(DISTINCT CASE WHEN late = 1 THEN customer_id END) AS affected_customers FROM oi GROUP BY department""",
)
over_items(
    "group_target_mean",
    lambda d: A.group_target_mean(d, "segment", "late"),
    "order_id line_no product_id supplier_id l_shipdate segment late",
    """SELECT order_id, line_no, product_id, supplier_id, l_shipdate, segment, late,
       round(avg(late) OVER (PARTITION BY segment), 6) AS target_mean FROM oi""",
)
over_items(
    "topk_by_measure",
    lambda d: d.groupBy("category").agg(
        F.sum("qty").cast("long").alias("total_qty"), A.rows().alias("order_count"),
        A.r(F.avg("late")).alias("late_rate"), A.r(F.avg(A.delay())).alias("avg_delay"),
    ).orderBy(F.desc("total_qty"), "category").limit(15),
    "category qty late days_real days_sched",
    """SELECT category, CAST(sum(qty) AS BIGINT) AS total_qty, count(*) AS order_count, round(avg(late), 6) AS late_rate,
       round(avg(days_real - days_sched), 6) AS avg_delay FROM oi GROUP BY category
       ORDER BY total_qty DESC, category LIMIT 15""",
)
