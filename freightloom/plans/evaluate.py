"""Evaluation of forecasts and scores.

The predictors checked against SQL are the deterministic baselines: the mean quantity of the seven rows before (demand) and the late
rate of the earlier rows (lateness). Their scores are stored as a table, as a forecast run would be.
"""

from pyspark.sql import functions as F

from freightloom.functions.scalars import ratio, risk_label
from freightloom.operators import evaluate as E
from freightloom.operators import features as X
from freightloom.operators.analytics import r
from freightloom.operators.ordered import running
from freightloom.operators.forecasts import matched_cells, monthly_cells
from freightloom.plans.features import KEY, KEYS, frame_sql, rate_sql
from freightloom.plans.registry import over_items, register, with_views
from freightloom.plans.views import CELLS, ORDER_BY, cells_sql
from freightloom.session import prepare, setting, stored_table
from freightloom.sources import TOTAL_ORDER, order_lines

_COLS = [*TOTAL_ORDER, "slot", "period", "department", "category", "region", "ship_mode", "qty", "late", "sales", "product_price", "days_sched", "days_real"]


def score(d):
    """Scores of rows that lie by slot; no row leaves its slot."""
    rates = {"p_sup": ["department", "ship_mode"], "p_route": ["ship_mode", "region"]}
    sums = running(d, TOTAL_ORDER, X.SEGMENT, X.rate_sums("late", rates, needed=X.CELL), laid=X.RANGE)
    scored = X.demand_frames(X.rates(sums.dropna(subset=X.SEGMENT), "late", rates, 30), base=d, laid=X.RANGE).dropna(subset=["department", "ship_mode"])
    return scored.withColumns({"p_qty": F.coalesce("qty_roll_7", F.lit(0.0)), "p_qty30": F.coalesce("qty_roll_30", F.lit(0.0))}).drop(
        "qty_std_14", "qty_std_30", "qty_prev", "qty_back_7", "qty_back_30", "qty_mean_14", "qty_roll_7", "qty_roll_30")


def load_scores(spark, sf_dir):
    # Totals that are joined by slot and more come to the slots.
    with setting(prepare(spark), "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return stored_table(spark, "scores", sf_dir, lambda: score(order_lines(spark, sf_dir, *_COLS)))


SCORED = f"""SELECT *, coalesce({frame_sql('avg(qty)', 7)}, 0.0) AS p_qty, coalesce({frame_sql('avg(qty)', 30)}, 0.0) AS p_qty30,
  {rate_sql('late', 'department, ship_mode', 30)} AS p_sup, {rate_sql('late', 'ship_mode, region', 30)} AS p_route FROM oi"""


def over_scores(name, run, sql, **views):
    register(name, lambda spark, sf_dir: run(load_scores(spark, sf_dir)), with_views(sql, scored=SCORED, **views))


def reg_sql(y, p):
    return f"""count(*) AS n, round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse,
      round(avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) END) * 100, 6) AS mape,
      round(1 - sum(({y} - {p}) * ({y} - {p})) / (sum({y} * {y}) - sum({y}) * avg({y})), 6) AS r2"""


over_scores("regression_metrics", lambda s: E.regression_metrics(s, "qty", "p_qty", "category"), f"SELECT category, {reg_sql('qty', 'p_qty')} FROM scored GROUP BY category")


def cls_sql(y, p):
    return f"""tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
      round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1
      FROM (SELECT *, count(*) FILTER ({p} >= 0.5 AND {y} = 1) AS tp, count(*) FILTER ({p} >= 0.5 AND {y} = 0) AS fp,
        count(*) FILTER ({p} < 0.5 AND {y} = 1) AS fn, count(*) FILTER ({p} < 0.5 AND {y} = 0) AS tn"""


_CLS = cls_sql("late", "p_sup").replace("SELECT *, ", "SELECT region, ")
over_scores("classification_metrics", lambda s: E.classification_metrics(s, "late", "p_sup", 0.5, "region"), f"SELECT region, {_CLS} FROM scored GROUP BY region)")
over_scores(
    "roc_auc", lambda s: E.roc_auc(s, "late", "p_sup"),
    """SELECT CAST(sum(late) AS BIGINT) AS positives, CAST(sum(1 - late) AS BIGINT) AS negatives,
       round((sum(CASE WHEN late = 1 THEN rk ELSE 0 END) - sum(late) * (sum(late) + 1) / 2) / (sum(late) * sum(1 - late)), 6) AS auc
       FROM (SELECT late, rank() OVER (ORDER BY p_sup) + (count(*) OVER (PARTITION BY p_sup) - 1) / 2 AS rk FROM scored)""",
)
_C = "abs(p_sup - 0.5) * 2"
over_scores("confidence_cls", lambda s: E.confidence_classes(s, "p_sup"),
            f"""SELECT CASE WHEN {_C} >= 0.7 THEN 'high' WHEN {_C} >= 0.4 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, round(avg({_C}), 6) AS mean_confidence
                FROM scored GROUP BY 1""")
over_scores(
    "calibration_ece", lambda s: E.calibration_ece(s, "late", "p_sup"),
    """, b AS (SELECT CAST(least(floor(p_sup * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p_sup) AS c, avg(late) AS a FROM scored GROUP BY 1)
       SELECT bin, n, round(c, 6) AS mean_score, round(a, 6) AS observed, round((SELECT sum(n * abs(a - c)) / sum(n) FROM b), 6) AS ece FROM b""",
)
over_scores(
    "confidence_reg", lambda s: E.confidence_reg(s, "qty", "p_qty").select(*KEY, "confidence", "confidence_range"),
    f"""SELECT {KEYS}, round(greatest(least(1 - abs(qty - p_qty) / mx, 1.0), 0.0), 6) AS confidence,
        round(greatest(least(1 - abs((p_qty - lo) / (hi - lo) - 0.5) * CAST(0.4 AS DOUBLE), 1.0), 0.0), 6) AS confidence_range
        FROM scored, (SELECT max(abs(qty - p_qty)) AS mx, min(p_qty) AS lo, max(p_qty) AS hi FROM scored)""",
)


def walk_forward(s):
    """Metrics per fold of the expanding walk."""
    rows = E.walk_forward_rows(s.select(*TOTAL_ORDER, "slot", "qty", "late", "p_qty", "p_sup"), TOTAL_ORDER, X.SEGMENT)
    cls = E.classification_metrics(rows, "late", "p_sup", 0.5, "fold").select("fold", "accuracy", "f1")
    return E.regression_metrics(rows, "qty", "p_qty", "fold", "train_end").join(cls, "fold")


over_scores(
    "walk_forward", walk_forward,
    f"""SELECT fold, train_end, {reg_sql('qty', 'p_qty')}, round(avg(CASE WHEN (p_sup >= 0.5) = (late = 1) THEN 1 ELSE 0 END), 6) AS accuracy,
        round(2 * count(*) FILTER (p_sup >= 0.5 AND late = 1) / (2 * count(*) FILTER (p_sup >= 0.5 AND late = 1) + count(*) FILTER ((p_sup >= 0.5) <> (late = 1))), 6) AS f1
        FROM (SELECT *, row_number() OVER (ORDER BY {ORDER_BY}) - 1 AS pos FROM scored) JOIN (
          SELECT CAST(i AS INTEGER) AS fold, CAST(floor(n * 0.5) + floor((n - floor(n * 0.5)) / 5) * i AS BIGINT) AS train_end,
            least(floor(n * 0.5) + floor((n - floor(n * 0.5)) / 5) * i + floor(n * 0.1), n) AS test_end
          FROM (SELECT count(*) AS n FROM oi), range(5) t(i)) ON pos >= train_end AND pos < test_end GROUP BY fold, train_end""",
)
_FEATS = ["days_real", "days_sched", "qty", "p_sup"]


def _mi(c):
    return f"""SELECT '{c}' AS feature, corr, mi, CASE WHEN corr > 0.85 OR mi > 0.55 THEN 'FAIL' WHEN corr > 0.70 THEN 'SUSPECT' ELSE 'PASS' END AS verdict
      FROM (SELECT abs(corr({c}, late)) AS corr FROM scored), (
        SELECT sum(n / t * ln(n * t / (x * z))) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS x, sum(n) OVER (PARTITION BY late) AS z
          FROM (SELECT late, least(floor(({c} - lo) / (hi - lo) * 20), 19) AS b, count(*) AS n FROM scored, (SELECT min({c}) AS lo, max({c}) AS hi FROM scored) GROUP BY ALL)))"""


over_scores(
    "leakage_audit", lambda s: E.leakage_audit(s, _FEATS, "late"),
    "SELECT feature, round(corr, 6) AS target_corr, round(mi, 6) AS mutual_info, verdict FROM (" + " UNION ALL ".join(_mi(c) for c in _FEATS) + ")",
)


def agents_distinct(s):
    """Correlation of every pair of prediction columns; above 0.95 two agents say the same."""
    from freightloom.operators.quality import correlations

    d = correlations(s, ["p_qty", "p_sup", "p_route"])
    return d.select("column_1", "column_2", r(F.col("correlation")).alias("correlation"), (F.col("correlation") <= 0.95).cast("int").alias("distinct_enough"))


over_scores(
    "agents_distinct", agents_distinct,
    "SELECT column_1, column_2, round(c, 6) AS correlation, CASE WHEN c <= 0.95 THEN 1 ELSE 0 END AS distinct_enough FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, abs(corr({a}, {b})) AS c FROM scored" for a, b in (("p_qty", "p_sup"), ("p_qty", "p_route"), ("p_sup", "p_route"))) + ")",
)
over_scores(
    "predictions_summary",
    lambda s: s.groupBy(risk_label("p_sup").alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("p_sup")).alias("mean"), r(F.stddev_pop("p_sup")).alias("std"), r(F.min("p_sup")).alias("min"), r(F.max("p_sup")).alias("max")),
    """SELECT CASE WHEN p_sup >= 0.75 THEN 'critical' WHEN p_sup >= 0.5 THEN 'high' WHEN p_sup >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n,
       round(avg(p_sup), 6) AS mean, round(stddev_pop(p_sup), 6) AS std, round(min(p_sup), 6) AS min, round(max(p_sup), 6) AS max FROM scored GROUP BY 1""",
)
over_scores(
    "backtest_monthly", lambda s: E.backtest_monthly(s, "p_qty"),
    """SELECT period, n, round(m, 6) AS predicted, round(greatest(least(1 - s / (abs(m) + 1e-6), 1.0), 0.0), 6) AS confidence, round(m - CAST(1.96 AS DOUBLE) * s, 6) AS lower,
       round(m + CAST(1.96 AS DOUBLE) * s, 6) AS upper FROM (SELECT period, count(*) AS n, avg(p_qty) AS m, stddev_pop(p_qty) AS s FROM scored GROUP BY period ORDER BY period DESC LIMIT 12)""",
)
over_scores(
    "forecast_future", lambda s: E.forecast_future(s, "p_qty"),
    """SELECT strftime(d + to_months(i), '%Y-%m') AS period, i AS horizon, round(m, 6) AS predicted,
       round(least(greatest(1 - s / (abs(m) + 1e-6), 0.0) * power(CAST(0.95 AS DOUBLE), i), 1.0), 6) AS confidence,
       round(m - CAST(1.96 AS DOUBLE) * s * (1 + CAST(0.1 AS DOUBLE) * i), 6) AS lower, round(m + CAST(1.96 AS DOUBLE) * s * (1 + CAST(0.1 AS DOUBLE) * i), 6) AS upper
       FROM (SELECT avg(p_qty) AS m, stddev_pop(p_qty) AS s, max(order_date) AS d FROM scored WHERE period = (SELECT max(period) FROM scored)),
            (SELECT CAST(i AS INTEGER) AS i FROM range(1, 7) t(i))""",
)
FCELLS = """SELECT category, region, n AS order_count, round(sr, 6) AS supplier_risk, round(lr, 6) AS logistics_risk, round(q, 6) AS predicted_units, round(d, 4) AS predicted_demand,
  round(d * price, 2) AS predicted_revenue, round((sr + lr) / 2, 6) AS combined_risk,
  CASE WHEN (sr + lr) / 2 >= 0.65 THEN 'high' WHEN (sr + lr) / 2 >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level
  FROM (SELECT category, region, count(*) AS n, avg(p_sup) AS sr, avg(p_route) AS lr, avg(p_qty) AS q, avg(sales) AS d, avg(product_price) AS price
    FROM scored WHERE period = (SELECT max(period) FROM scored WHERE period < (SELECT strftime(max(order_date) + INTERVAL 1 DAY, '%Y-%m') FROM scored)) GROUP BY category, region HAVING count(*) >= {f})"""


def complete_months(s):
    """Rows of the months that the data cover to their last day: the newest of them is the template of a forecast."""
    return s.where(F.col("period") < s.agg(F.date_format(F.date_add(F.max("order_date"), 1), "yyyy-MM")).scalar())


over_scores("auto_forecast_cells", lambda s: E.forecast_cells(complete_months(s)), FCELLS.format(f=5))


def graph_aware(s):
    """Weighted combined risk 0.35 / 0.30 / 0.35 of demand deviation, supplier and route risk per cell."""
    last = s.agg(F.max("period")).scalar()
    g = s.where(F.col("period") == last).groupBy("category", "region").agg(
        F.avg(F.least(F.abs(F.col("p_qty") - F.col("p_qty30")) / F.greatest("p_qty30", F.lit(1.0)), F.lit(1.0))).alias("dr"),
        F.avg("p_sup").alias("sr"), F.avg("p_route").alias("lr"), F.count(F.lit(1)).alias("n"))
    c = 0.35 * F.col("dr") + 0.30 * F.col("sr") + 0.35 * F.col("lr")
    return g.select("category", "region", "n", r(F.col("dr")).alias("demand_risk"), r(c).alias("combined_risk"), risk_label(c).alias("risk_level"))


_G = "(CAST(0.35 AS DOUBLE) * dr + CAST(0.30 AS DOUBLE) * sr + CAST(0.35 AS DOUBLE) * lr)"
over_scores(
    "graph_aware_forecast", graph_aware,
    f"""SELECT category, region, n, round(dr, 6) AS demand_risk, round({_G}, 6) AS combined_risk,
        CASE WHEN {_G} >= 0.75 THEN 'critical' WHEN {_G} >= 0.5 THEN 'high' WHEN {_G} >= 0.25 THEN 'medium' ELSE 'low' END AS risk_level
        FROM (SELECT category, region, count(*) AS n, avg(least(abs(p_qty - p_qty30) / greatest(p_qty30, 1.0), 1.0)) AS dr, avg(p_sup) AS sr, avg(p_route) AS lr
          FROM scored WHERE period = (SELECT max(period) FROM scored) GROUP BY category, region)""",
)
_MC = "category region department city period qty late sales"
over_items(
    "deviation_metrics", lambda d: E.deviation_metrics(matched_cells(d), "actual", "forecast"), _MC,
    """SELECT count(*) AS n, round(avg(p), 6) AS mape, round(sqrt(avg((actual - forecast) * (actual - forecast))) / (max(actual) - min(actual)), 6) AS nrmse,
       count(*) FILTER (p > 15) AS anomalies, CASE WHEN avg(p) > 15 OR count(*) FILTER (p > 15) > 0 THEN 1 ELSE 0 END AS threshold_breach
       FROM (SELECT *, abs(actual - forecast) / greatest(abs(actual), 1.0) * 100 AS p FROM cells WHERE forecast IS NOT NULL)""",
    cells=CELLS,
)


def cycle_metrics(s):
    """Metrics of one monthly cycle: the newest month against the forecasts made from earlier rows."""
    last = s.agg(F.max("period")).scalar()
    m = s.where(F.col("period") == last)
    a = E.regression_metrics(m, "qty", "p_qty", "period").select("period", "n", "mae", "rmse", "mape")
    b = E.classification_metrics(m, "late", "p_sup", 0.5, "period").select("period", "precision", "recall", "f1")
    return a.join(b, "period").join(m.groupBy("period").agg(r(F.avg("late")).alias("actual_late_rate")), "period")


_CYC = cls_sql("late", "p_sup").replace("SELECT *, ", "SELECT period, ")
over_scores(
    "cycle_metrics", cycle_metrics,
    f"""SELECT a.period, n, mae, rmse, mape, precision, recall, f1, actual_late_rate FROM
        (SELECT period, {reg_sql('qty', 'p_qty')}, round(avg(late), 6) AS actual_late_rate FROM scored WHERE period = (SELECT max(period) FROM scored) GROUP BY period) a
        JOIN (SELECT period, {_CYC} FROM scored WHERE period = (SELECT max(period) FROM scored) GROUP BY period)) b ON a.period = b.period""",
)


def prediction_vs_actual(d):
    m = matched_cells(d)
    e = F.abs(F.col("actual") - F.col("forecast"))
    return m.groupBy("region").agg(
        r(F.avg(e), 4).alias("mae"), r(F.avg(e / F.greatest(F.abs("actual"), F.lit(1.0))) * 100, 4).alias("mape"),
        r(F.greatest(100 - F.avg(e / F.greatest(F.abs("actual"), F.lit(1.0))) * 100, F.lit(0.0)), 4).alias("accuracy"),
        r(F.avg("forecast"), 4).alias("avg_prediction"), r(F.avg("actual"), 4).alias("avg_actual"))


over_items(
    "prediction_vs_actual", prediction_vs_actual, _MC,
    """SELECT region, round(avg(e), 4) AS mae, round(avg(e / greatest(abs(actual), 1.0)) * 100, 4) AS mape,
       round(greatest(100 - avg(e / greatest(abs(actual), 1.0)) * 100, 0.0), 4) AS accuracy, round(avg(forecast), 4) AS avg_prediction, round(avg(actual), 4) AS avg_actual
       FROM (SELECT *, abs(actual - forecast) AS e FROM cells WHERE forecast IS NOT NULL) GROUP BY region""",
    cells=CELLS,
)
over_scores(
    "ab_compare", lambda s: E.ab_compare(s.select((F.col("qty") / 50).alias("y"), (F.col("p_qty") / 50).alias("c"), (F.col("p_qty30") / 50).alias("t")), "y", "c", "t"),
    """SELECT round(cm, 6) AS control_mape, round(tm, 6) AS treatment_mape, round(cf, 6) AS control_f1, round(tf, 6) AS treatment_f1,
         round((cm - tm) / greatest(cm, 1e-6) * 100, 4) AS mape_gain_pct, round((tf - cf) / greatest(cf, 1e-6) * 100, 4) AS f1_gain_pct,
         CASE WHEN abs((cm - tm) / cm * 100) < 2 THEN 'tie' WHEN (cm - tm) / cm * 100 > 5 THEN 'treatment' ELSE 'control' END AS winner,
         CASE WHEN abs((cm - tm) / cm * 100) < 2 THEN 'low' WHEN abs((cm - tm) / cm * 100) > 10 THEN 'high' ELSE 'medium' END AS confidence
       FROM (SELECT avg(abs(y - c) / greatest(abs(y), 1e-6)) AS cm, avg(abs(y - t) / greatest(abs(y), 1e-6)) AS tm,
           2 * count(*) FILTER (c > 0.5 AND y > 0.5) / (2 * count(*) FILTER (c > 0.5 AND y > 0.5) + count(*) FILTER ((c > 0.5) <> (y > 0.5))) AS cf,
           2 * count(*) FILTER (t > 0.5 AND y > 0.5) / (2 * count(*) FILTER (t > 0.5 AND y > 0.5) + count(*) FILTER ((t > 0.5) <> (y > 0.5))) AS tf
         FROM (SELECT qty / 50 AS y, p_qty / 50 AS c, p_qty30 / 50 AS t FROM scored))""",
)

# Prediction history of the agents: demand and lateness forecasts per cell and month with what happened later.
MEMORY = f"""
SELECT agent || '|' || category || '|' || region || '|' || period AS record_id, agent, category, region, period, prediction, actual, confidence,
  greatest(1 - abs(prediction - actual) / greatest(abs(actual), 1.0), 0.0) AS accuracy FROM (
  SELECT 'demand' AS agent, category, region, period, forecast AS prediction, actual, 1 - 1 / sqrt(orders + 1) AS confidence FROM cells WHERE forecast IS NOT NULL
  UNION ALL SELECT 'logistics', category, region, period, p_late, late_rate, 1 - 1 / sqrt(orders + 1) FROM (
    SELECT *, avg(late_rate) OVER (PARTITION BY category, region ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p_late FROM cells) WHERE forecast IS NOT NULL
  UNION ALL SELECT 'supplier', department, '', period, p_late, late_rate, 1 - 1 / sqrt(orders + 1) FROM (
    SELECT *, avg(late_rate) OVER (PARTITION BY department ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p_late FROM (""" + cells_sql("department") + """)) WHERE forecast IS NOT NULL
  UNION ALL SELECT 'inventory', city, '', period, forecast, actual, 1 - 1 / sqrt(orders + 1) FROM (""" + cells_sql("city") + """) WHERE forecast IS NOT NULL)"""


def agent_memory(d):
    """Prediction history rows: record_id, agent, category, region, period, prediction, actual, confidence, accuracy."""
    from pyspark.sql import Window

    def told(keys, *agents):
        """Rows of agents that forecast the next month of a key by the mean of its last three."""
        w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-3, -1)
        c = monthly_cells(d, keys).withColumn("p_late", F.avg("late_rate").over(w)).where("forecast IS NOT NULL")
        kinds = F.array(*[F.struct(F.lit(a).alias("agent"), F.col(p).alias("prediction"), F.col(y).cast("double").alias("actual")) for a, p, y in agents])
        ids = [F.col(k).alias(n) for k, n in zip(keys, ("category", "region"), strict=False)] + ([F.lit("").alias("region")] if len(keys) == 1 else [])
        return c.select(*ids, "period", (1 - 1 / F.sqrt(F.col("orders") + 1)).alias("confidence"), F.explode(kinds).alias("k")).select("*", "k.*").drop("k")

    m = told(("category", "region"), ("demand", "forecast", "actual"), ("logistics", "p_late", "late_rate"))
    m = m.unionByName(told(("department",), ("supplier", "p_late", "late_rate"))).unionByName(told(("city",), ("inventory", "forecast", "actual")))
    return record_accuracy(m).withColumn("record_id", F.concat_ws("|", "agent", "category", "region", "period"))


def record_accuracy(m):
    gap = F.abs(F.col("prediction") - F.col("actual")) / F.greatest(F.abs("actual"), F.lit(1.0))
    return m.withColumn("accuracy", F.greatest(1 - gap, F.lit(0.0)))


def over_memory(name, run, sql, **views):
    over_items(name, lambda d: run(agent_memory(d)), _MC, sql, **{"cells": CELLS, "memory": MEMORY, **views})


over_memory("record_accuracy", lambda m: m.select("record_id", r(F.col("prediction")).alias("prediction"), r(F.col("actual")).alias("actual"), r(F.col("accuracy")).alias("accuracy")),
            "SELECT record_id, round(prediction, 6) AS prediction, round(actual, 6) AS actual, round(accuracy, 6) AS accuracy FROM memory")


def latest(m, n):
    """Newest `n` records per agent; the cut happens before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("agent").orderBy(F.desc("period"), "record_id")
    return m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def memory_stats(m):
    """Counts and means per agent with the last 20 accuracies (a list of fixed length)."""
    g = m.groupBy("agent").agg(F.count(F.lit(1)).alias("predictions"), F.count("actual").alias("validated"), r(F.avg("accuracy")).alias("mean_accuracy"), r(F.avg("confidence")).alias("mean_confidence"))
    tail = latest(m, 20).groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("rn", r(F.col("accuracy"), 4).alias("a")))).alias("l"))
    return g.join(tail.select("agent", F.array_join(F.transform("l", lambda x: F.format_number(x["a"], 4)), ",").alias("last_20")), "agent")


over_memory(
    "memory_stats", memory_stats,
    """, t AS (SELECT agent, string_agg(format('{:.4f}', round(accuracy, 4)), ',' ORDER BY rn) AS last_20 FROM (
         SELECT *, row_number() OVER (PARTITION BY agent ORDER BY period DESC, record_id) AS rn FROM memory) WHERE rn <= 20 GROUP BY agent)
       SELECT agent, count(*) AS predictions, count(actual) AS validated, round(avg(accuracy), 6) AS mean_accuracy, round(avg(confidence), 6) AS mean_confidence,
         any_value(last_20) AS last_20 FROM memory JOIN t USING (agent) GROUP BY agent""",
)
over_memory(
    "patterns_from_memory",
    lambda m: m.where("accuracy < 0.70").select(
        "record_id", F.concat(F.upper("agent"), F.lit("_AGENT")).alias("source_id"), F.concat(F.upper("agent"), F.lit("_DEVIATION_LEARNED")).alias("rel_type"),
        r(1 - F.col("accuracy")).alias("weight"), r(F.col("confidence")).alias("confidence"), r(F.col("confidence") * 0.8).alias("probability")),
    """SELECT record_id, upper(agent) || '_AGENT' AS source_id, upper(agent) || '_DEVIATION_LEARNED' AS rel_type, round(1 - accuracy, 6) AS weight,
       round(confidence, 6) AS confidence, round(confidence * CAST(0.8 AS DOUBLE), 6) AS probability FROM memory WHERE accuracy < 0.70""",
)


def adaptive_weights(m):
    g = latest(m, 100).groupBy("agent").agg(F.avg("accuracy").alias("s"))
    return g.select("agent", r(F.col("s")).alias("mean_score"), r(ratio("s", g.agg(F.sum("s")).scalar())).alias("weight"))


over_memory(
    "adaptive_weights", adaptive_weights,
    """, g AS (SELECT agent, avg(accuracy) AS s FROM (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY period DESC, record_id) AS rn FROM memory) WHERE rn <= 100 GROUP BY agent)
       SELECT agent, round(s, 6) AS mean_score, round(s / (SELECT sum(s) FROM g), 6) AS weight FROM g""",
)
# Weight of each agent before its accuracy is known.
_WEIGHTS = {"demand": 0.30, "supplier": 0.35, "inventory": 0.20, "logistics": 0.15}
over_memory(
    "consensus_weighting",
    lambda m: E.consensus(m.groupBy("agent").agg(F.avg("accuracy").alias("accuracy"), F.avg("confidence").alias("confidence"), (1 - F.avg("accuracy")).alias("risk")), _WEIGHTS),
    """, a AS (SELECT agent, (CASE agent WHEN 'demand' THEN CAST(0.30 AS DOUBLE) WHEN 'supplier' THEN 0.35 WHEN 'inventory' THEN 0.20 ELSE 0.15 END) * avg(accuracy) * avg(confidence) AS e, 1 - avg(accuracy) AS k FROM memory GROUP BY agent)
       SELECT agent, round(e, 6) AS effective, round(e / (SELECT sum(e) FROM a), 6) AS weight, round(k, 6) AS risk, round((SELECT sum(e * k) / sum(e) FROM a), 6) AS overall_risk FROM a""",
)
over_memory(
    "running_average",
    lambda m: m.groupBy("agent", "period").agg(F.sum("accuracy").alias("s"), F.count(F.lit(1)).alias("c")).transform(_running),
    """SELECT agent, period, round(sum(s) OVER w / sum(c) OVER w, 6) AS running_accuracy, CAST(sum(c) OVER w AS BIGINT) AS n
       FROM (SELECT agent, period, sum(accuracy) AS s, count(*) AS c FROM memory GROUP BY agent, period) WINDOW w AS (PARTITION BY agent ORDER BY period)""",
)


def _running(g):
    from pyspark.sql import Window

    w = Window.partitionBy("agent").orderBy("period")
    return g.select("agent", "period", r(F.sum("s").over(w) / F.sum("c").over(w)).alias("running_accuracy"), F.sum("c").over(w).alias("n"))


def signal_injection(s):
    """A high demand risk of the whole network raises the quantities the supplier model sees by up to 30 %."""
    sig = s.agg(F.avg("p_sup").alias("p")).scalar()
    surge = F.when(risk_label(sig).isin("high", "critical") | (sig > 0.4), 1 + sig * 0.3).otherwise(1.0)
    return s.select(*KEY, r(F.col("qty") * surge).alias("qty_signal"))


over_scores(
    "signal_injection", signal_injection,
    f"""SELECT {KEYS}, round(qty * (SELECT CASE WHEN avg(p_sup) > 0.4 THEN 1 + avg(p_sup) * CAST(0.3 AS DOUBLE) ELSE 1.0 END FROM scored), 6) AS qty_signal FROM scored""",
)
over_scores(
    "prediction_interval",
    lambda s: s.select(*KEY, *[r(F.col("p_qty") * (1 + k * F.greatest(F.least(_vol() * 0.5, F.lit(0.40)), F.lit(0.10)))).alias(n) for k, n in ((-1, "lower"), (1, "upper"))]),
    f"""SELECT {KEYS}, round(p_qty * (1 + -1 * c), 6) AS lower, round(p_qty * (1 + 1 * c), 6) AS upper
        FROM (SELECT *, greatest(least(abs(p_qty - p_qty30) / greatest(p_qty30, 1.0) * 0.5, 0.40), 0.10) AS c FROM scored)""",
)


def _vol():
    return F.abs(F.col("p_qty") - F.col("p_qty30")) / F.greatest("p_qty30", F.lit(1.0))


def decision_table(s):
    """Per department: act when its risk passes the threshold; ROI from the action's cost and savings parameters.

    The parameters (threshold, cost, savings) are inputs of the rule; here the cost is 2 % of the department's sales and the savings are the sales at risk.
    """
    g = s.groupBy("department").agg(F.avg("p_sup").alias("sr"), F.avg("p_route").alias("lr"), F.sum("sales").alias("v"))
    act = F.col("sr") >= 0.45
    cost, save = F.col("v") * 0.02, F.col("v") * F.col("sr") * 0.12
    return g.select(
        "department", F.when(act, "reallocate").otherwise("maintain").alias("action"), F.when(act, "HIGH").otherwise("MEDIUM").alias("priority"),
        r(F.when(act, (save - cost) / F.greatest(cost, F.lit(1.0)) * 100).otherwise(0.0), 4).alias("roi_pct"),
        r(F.greatest(F.least(1 - (F.col("sr") * 0.45 + F.col("lr") * 0.55), F.lit(0.98)), F.lit(0.70)), 4).alias("confidence"))


over_scores(
    "decision_table", decision_table,
    """SELECT department, CASE WHEN sr >= 0.45 THEN 'reallocate' ELSE 'maintain' END AS action, CASE WHEN sr >= 0.45 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
       round(CASE WHEN sr >= 0.45 THEN (v * sr * CAST(0.12 AS DOUBLE) - v * CAST(0.02 AS DOUBLE)) / greatest(v * CAST(0.02 AS DOUBLE), 1.0) * 100 ELSE 0.0 END, 4) AS roi_pct,
       round(greatest(least(1 - (sr * CAST(0.45 AS DOUBLE) + lr * CAST(0.55 AS DOUBLE)), 0.98), 0.70), 4) AS confidence
       FROM (SELECT department, avg(p_sup) AS sr, avg(p_route) AS lr, sum(sales) AS v FROM scored GROUP BY department)""",
)


# Forecast results as a table: entity type, entity, period, value, confidence and risk flag.
FORECASTS = """
SELECT 'Supplier' AS entity_type, department AS entity_id, period, avg(p_sup) AS predicted, 1 - 1 / sqrt(count(*) + 1) AS confidence FROM scored GROUP BY department, period
UNION ALL SELECT 'Product', category, period, avg(p_qty), 1 - 1 / sqrt(count(*) + 1) FROM scored GROUP BY category, period
UNION ALL SELECT 'Shipment', ship_mode, period, avg(p_route), 1 - 1 / sqrt(count(*) + 1) FROM scored GROUP BY ship_mode, period"""
_FLAG = "CASE WHEN entity_type <> 'Product' AND predicted >= 0.5 THEN 1 ELSE 0 END"


def forecast_results(s):
    def part(kind, key, value):
        return s.groupBy(F.lit(kind).alias("entity_type"), F.col(key).alias("entity_id"), "period").agg(
            F.avg(value).alias("predicted"), (1 - 1 / F.sqrt(F.count(F.lit(1)) + 1)).alias("confidence"))

    d = part("Supplier", "department", "p_sup").unionByName(part("Product", "category", "p_qty")).unionByName(part("Shipment", "ship_mode", "p_route"))
    return d.withColumn("risk_flag", ((F.col("entity_type") != "Product") & (F.col("predicted") >= 0.5)).cast("int"))


def load_forecasts(spark, sf_dir):
    return stored_table(spark, "forecasts", sf_dir, lambda: forecast_results(load_scores(spark, sf_dir)))


def over_forecasts(name, run, sql, **views):
    register(name, lambda spark, sf_dir: run(load_forecasts(spark, sf_dir)),
             with_views(sql, scored=SCORED, fc=f"SELECT *, {_FLAG} AS risk_flag FROM ({FORECASTS})", **views))


_FR = ["entity_type", "entity_id", "period"]


def shown(d):
    return d.select(*_FR, r(F.col("predicted")).alias("predicted"), r(F.col("confidence")).alias("confidence"))


_SHOWN = "entity_type, entity_id, period, round(predicted, 6) AS predicted, round(confidence, 6) AS confidence"
over_forecasts("asof_latest_run", lambda f: shown(f.where(F.col("period") == f.agg(F.max("period")).scalar())),
               f"SELECT {_SHOWN} FROM fc WHERE period = (SELECT max(period) FROM fc)")
over_forecasts("risk_flagged", lambda f: shown(f.where("risk_flag = 1").orderBy(F.desc_nulls_last("confidence"), *_FR)),
               f"SELECT {_SHOWN} FROM fc WHERE risk_flag = 1")
over_forecasts(
    "entity_forecast_history",
    lambda f: shown(f.where((F.col("entity_type") == "Supplier") & (F.col("entity_id") == f.where("entity_type = 'Supplier'").agg(F.min("entity_id")).scalar())).orderBy(F.desc("period"))),
    f"SELECT {_SHOWN} FROM fc WHERE entity_type = 'Supplier' AND entity_id = (SELECT min(entity_id) FROM fc WHERE entity_type = 'Supplier')",
)
over_forecasts(
    "forecast_risk_counts",
    lambda f: f.where("entity_type <> 'Product'").groupBy("entity_type", E.risk_label_3("predicted").alias("risk_level")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("confidence")).alias("mean_confidence")),
    """SELECT entity_type, CASE WHEN predicted >= 0.65 THEN 'high' WHEN predicted >= 0.35 THEN 'medium' ELSE 'low' END AS risk_level, count(*) AS n,
       round(avg(confidence), 6) AS mean_confidence FROM fc WHERE entity_type <> 'Product' GROUP BY 1, 2""",
)


def alert_rules(f):
    """Forecast rows to alerts, without entities whose alerts are dismissed (here: once predicted below 0.2)."""
    name = (
        F.when((F.col("entity_type") == "Product") & (F.col("predicted") > 25.5), "Demand Spike")
        .when((F.col("entity_type") == "Shipment") & ((F.col("risk_flag") == 1) | (F.col("confidence") < 0.65)), "Late Delivery Risk")
        .when((F.col("entity_type") == "Supplier") & ((F.col("risk_flag") == 1) | (F.col("confidence") < 0.70)), "Supplier Reliability Drop"))
    level = F.when(name == "Late Delivery Risk", "Critical").otherwise("High")
    a = f.select(*_FR, name.alias("alert"), level.alias("severity")).where("alert IS NOT NULL")
    dismissed = f.where("predicted < 0.2").select("entity_type", "entity_id").distinct()
    return a.join(dismissed, ["entity_type", "entity_id"], "left_anti")


over_forecasts(
    "alert_rules", alert_rules,
    """SELECT entity_type, entity_id, period, alert, CASE WHEN alert = 'Late Delivery Risk' THEN 'Critical' ELSE 'High' END AS severity FROM (
         SELECT *, CASE WHEN entity_type = 'Product' AND predicted > 25.5 THEN 'Demand Spike'
           WHEN entity_type = 'Shipment' AND (risk_flag = 1 OR confidence < 0.65) THEN 'Late Delivery Risk'
           WHEN entity_type = 'Supplier' AND (risk_flag = 1 OR confidence < 0.70) THEN 'Supplier Reliability Drop' END AS alert,
           min(predicted) OVER (PARTITION BY entity_type, entity_id) AS lowest FROM fc)
       WHERE alert IS NOT NULL AND NOT lowest < 0.2""",
)
