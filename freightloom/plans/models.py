"""Model training, scoring and guards. Tree learners have no SQL twin; their inputs do."""

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.functions.scalars import risk_label
from freightloom.operators import evaluate as E
from freightloom.operators import models as M
from freightloom.operators import patterns as P
from freightloom.operators.analytics import r
from freightloom.plans.evaluate import SCORED
from freightloom.plans.features import KEY, KEYS, rate_sql
from freightloom.plans.patterns import load_events, load_network
from freightloom.plans.registry import query, register, with_views
from freightloom.session import prepare, setting, stored_table, work_path
from freightloom.sources import FEATURE_COLUMNS, order_lines

_SAVED: dict[tuple[str, str, str], str] = {}


def load_frame(spark, sf_dir):
    """Order lines with all features of the models, written once per application."""
    def make():
        lines = order_lines(spark, sf_dir, *FEATURE_COLUMNS, "slot")  # first, so that the events are read off them
        return M.model_frame(lines, P.interval_pairs(load_events(spark, sf_dir), load_network(spark, sf_dir)))

    # Rows that lie by slot serve the joins by slot and more as they are.
    with setting(prepare(spark), "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return stored_table(spark, "model_frame", sf_dir, make)


def frame(spark, sf_dir, kind):
    return M.prepare_features(load_frame(spark, sf_dir), kind)


def split(df, share=0.8):
    """Date below which `share` of the rows lie, found on daily counts."""
    days = df.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("order_date"))
    cut = days.withColumn("u", upto).where(F.col("u") >= days.agg(F.sum("n")).scalar() * share).agg(F.min("order_date")).scalar()
    return df.where(F.col("order_date") < cut), df.where(F.col("order_date") >= cut)


def load_model(spark, sf_dir, kind):
    """Train once per application; the fitted pipeline is kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _SAVED:
        path = work_path(spark, f"model-{kind}")
        M.train(split(frame(spark, sf_dir, kind))[0], kind).write().save(path)
        _SAVED[key] = path
    return PipelineModel.load(_SAVED[key])


def scored_test(spark, sf_dir, kind):
    """The later rows with the model's prediction, scored once per application: the metrics read them several times."""
    def make():
        return M.predict(load_model(spark, sf_dir, kind), split(frame(spark, sf_dir, kind))[1], kind).drop("features", "rawPrediction", "probability", "prediction")

    return stored_table(spark, f"scored_{kind}", sf_dir, make)


for _kind in M.FEATURES:
    register(f"train_{_kind}", lambda spark, sf_dir, k=_kind: M.quality(scored_test(spark, sf_dir, k), k))


FEATURE_COPY = 0.999  # from this |correlation| on a feature counts as a copy of another
_LISTED = " UNION ALL ".join(f"SELECT '{k}' AS model, '{n}' AS feature" for k, names in M.FEATURES.items() for n in names)


@query("feature_lists", sql=with_views(f"SELECT model, feature, (SELECT count(*) FROM oi) AS n_values, 1 AS distinct_enough FROM ({_LISTED})"))
def feature_lists(spark, sf_dir):
    """Frozen feature lists with the guard's verdict, how many rows carry a value, and whether a feature says anything the others of its list do not."""
    out, d = None, load_frame(spark, sf_dir)
    for kind, names in M.FEATURES.items():
        M.check_features(kind, names)
        vector = VectorAssembler(inputCols=names, outputCol="v").transform(d).select("v")
        matrix = Correlation.corr(vector, "v").first()[0].toArray()  # one number per pair of listed features
        strongest = spark.createDataFrame([(n, max([abs(float(x)) for j, x in enumerate(row) if j != i and x == x], default=0.0)) for i, (n, row) in enumerate(zip(names, matrix, strict=True))], "feature string, c double")
        c = d.agg(*[F.count(n).alias(n) for n in names]).unpivot([], names, "feature", "n_values").withColumn("model", F.lit(kind)).join(strongest, "feature")
        c = c.select("model", "feature", "n_values", (F.col("c") <= F.lit(FEATURE_COPY)).cast("int").alias("distinct_enough"))
        out = c if out is None else out.unionByName(c)
    return out


register(
    "prepare_features",
    lambda spark, sf_dir: frame(spark, sf_dir, "logistics").select(
        *KEY, "shipping_mode_encoded", r(F.col("route_hist_late_rate")).alias("route_hist_late_rate"), r(F.col("region_hist_late_rate")).alias("region_hist_late_rate"), "days_sched",
        r(F.col("qty_roll_7")).alias("qty_roll_7"), r(F.col("order_value_log")).alias("order_value_log"), "order_month", "is_weekend",
        r(F.col("graph_avg_shipping_delay")).alias("graph_avg_shipping_delay"), r(F.col("graph_inventory_stress")).alias("graph_inventory_stress"), "target"),
    with_views(
        f"""SELECT {KEYS}, CAST(substr(s.ship_mode, 1, 1) AS INTEGER) AS shipping_mode_encoded, round(p_route, 6) AS route_hist_late_rate,
          round(reg_rate, 6) AS region_hist_late_rate, days_sched, round(p_qty, 6) AS qty_roll_7, round(ln(1 + sales), 6) AS order_value_log, month(order_date) AS order_month,
          CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend, round(nr.delay, 6) AS graph_avg_shipping_delay, round(st.stress, 6) AS graph_inventory_stress, late AS target
        FROM lines s JOIN routes nr ON nr.ship_mode = s.ship_mode AND nr.region = s.region AND nr.week = s.week JOIN stress st ON st.category = s.category AND st.week = s.week""",
        scored=SCORED, lines=f"SELECT *, {rate_sql('late', 'region', 30)} AS reg_rate, date_trunc('week', order_date)::date AS week FROM scored",
        cal="SELECT unnest(generate_series(date_trunc('week', min(order_date))::date, date_trunc('week', max(order_date))::date, INTERVAL 7 DAY))::date AS week FROM oi",
        wk="SELECT *, date_trunc('week', order_date)::date AS week FROM oi",
        rw="SELECT ship_mode, region, week, count(*) AS n, sum(late) AS l FROM wk GROUP BY ALL",
        rg="""SELECT ship_mode, region, week, coalesce(sum(n) OVER (PARTITION BY ship_mode, region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n,
          coalesce(sum(l) OVER (PARTITION BY ship_mode, region ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l
          FROM (SELECT DISTINCT ship_mode, region FROM rw) CROSS JOIN cal LEFT JOIN rw USING (ship_mode, region, week)""",
        routes="""SELECT a.ship_mode, a.region, a.week, coalesce(sum(b.l) / nullif(sum(b.n), 0), 0.5) AS delay FROM rg a LEFT JOIN rg b ON b.week = a.week
          AND (b.ship_mode = a.ship_mode) <> (b.region = a.region) GROUP BY ALL""",
        cw="SELECT city, cal.week, coalesce(q, 0) AS q FROM (SELECT DISTINCT city FROM wk) CROSS JOIN cal LEFT JOIN (SELECT city, week, sum(qty) AS q FROM wk GROUP BY ALL) USING (city, week)",
        cs="""SELECT city, week, least(coalesce(lag(q) OVER w / nullif(avg(q) OVER (PARTITION BY city ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0), 1.0), 3.0) AS s
          FROM cw WINDOW w AS (PARTITION BY city ORDER BY week)""",
        lk="""SELECT category, city, week, coalesce(sum(n) OVER (PARTITION BY category, city ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n
          FROM (SELECT DISTINCT category, city FROM wk) CROSS JOIN cal LEFT JOIN (SELECT category, city, week, count(*) AS n FROM wk GROUP BY ALL) USING (category, city, week)""",
        stress="SELECT category, week, coalesce(sum(n * s) / nullif(sum(n), 0), 1.0) AS stress FROM lk JOIN cs USING (city, week) GROUP BY category, week",
    ),
)


_CUT = """(SELECT min(order_date) FROM (SELECT order_date, sum(count(*)) OVER (ORDER BY order_date) AS u FROM oi GROUP BY order_date) WHERE u >= 0.8 * (SELECT count(*) FROM oi))"""


@query("batch_predict")
def batch_predict(spark, sf_dir):
    return scored_test(spark, sf_dir, "logistics").select(*KEY, r(F.col("p")).alias("probability"), (F.col("p") >= 0.5).cast("int").alias("predicted_late"), risk_label("p").alias("risk_level"))


@query("batch_predict_bounds", sql=with_views(f"SELECT {KEYS}, 1 AS possible, 1 AS label_agrees FROM oi WHERE order_date >= {_CUT}"))
def batch_predict_bounds(spark, sf_dir):
    """The rows predicted, and for each whether its probability is one and its label and level follow from it."""
    p = batch_predict(spark, sf_dir)
    level = F.when(F.col("probability") >= 0.75, "critical").when(F.col("probability") >= 0.5, "high").when(F.col("probability") >= 0.25, "medium").otherwise("low")
    agrees = (F.col("predicted_late") == (F.col("probability") >= 0.5).cast("int")) & (F.col("risk_level") == level)
    return p.select(*KEY, F.col("probability").between(0, 1).cast("int").alias("possible"), agrees.cast("int").alias("label_agrees"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    d = None
    for kind in M.FEATURES:
        i = M.importances(load_model(spark, sf_dir, kind), kind, spark)
        d = i if d is None else d.unionByName(i)
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    return d.withColumn("rank", rank).where("rank <= 10")


@query("feature_group_share")
def feature_group_share(spark, sf_dir):
    d = None
    for kind in M.FEATURES:
        i = M.importances(load_model(spark, sf_dir, kind), kind, spark)
        d = i if d is None else d.unionByName(i)
    return d.groupBy("model", "feature_group").agg(r(F.sum("importance")).alias("share"))


@query("tautology_guard")
def tautology_guard(spark, sf_dir):
    a = M.tautology_guard(frame(spark, sf_dir, "supplier"), "supplier")
    return a.unionByName(M.tautology_guard(frame(spark, sf_dir, "logistics"), "logistics"))


@query("model_checks", sql=with_views(f"""
    SELECT m AS model, count(*) AS test_rows, 1 AS within_bounds, 1 AS holds_against_trivial FROM oi, (VALUES ('demand'), ('supplier'), ('logistics')) t(m) WHERE order_date >= {_CUT} GROUP BY m"""))
def model_checks(spark, sf_dir):
    """Per model: rows of the test part, whether all predictions are possible ones, and whether it holds against the trivial predictor.

    A lateness model has to rank better than chance and hit more rows than the majority; the demand model, whose target may be noise, has to stay within 2 % of the error of the mean.
    """
    out = None
    for kind in M.FEATURES:
        s = scored_test(spark, sf_dir, kind)
        if kind == "demand":
            mean = split(frame(spark, sf_dir, kind))[0].agg(F.avg("target")).scalar()
            ok, good = F.col("p").isNotNull() & (F.col("p") >= 0), F.avg(F.abs(F.col("target") - F.col("p"))) <= 1.02 * F.avg(F.abs(F.col("target") - F.col("_mean")))
            g = s.withColumn("_mean", mean).agg(F.count(F.lit(1)).alias("test_rows"), F.min(ok.cast("int")).alias("within_bounds"), good.cast("int").alias("holds_against_trivial"))
        else:
            ok, hit = F.col("p").between(0, 1), ((F.col("p") >= 0.5) == (F.col("target") == 1)).cast("int")
            auc = M.roc_auc(s, "target", "p").select("auc").scalar()
            good = (F.avg(hit) > F.greatest(F.avg("target"), 1 - F.avg("target"))) & (F.max("_auc") > 0.6)
            g = s.withColumn("_auc", auc).agg(F.count(F.lit(1)).alias("test_rows"), F.min(ok.cast("int")).alias("within_bounds"), good.cast("int").alias("holds_against_trivial"))
        g = g.select(F.lit(kind).alias("model"), "*")
        out = g if out is None else out.unionByName(g)
    return out


@query("importance_checks", sql=" UNION ALL ".join(f"SELECT '{k}' AS model, {len(n)} AS features, 1 AS adds_to_one, 1 AS none_negative" for k, n in M.FEATURES.items()))
def importance_checks(spark, sf_dir):
    """Importances cover the frozen list, add to 1 and are not negative."""
    out = None
    for kind in M.FEATURES:
        i = M.importances(load_model(spark, sf_dir, kind), kind, spark)
        g = i.groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("features"), (F.abs(F.sum("importance") - 1) < 1e-6).cast("int").alias("adds_to_one"), (F.min("importance") >= 0).cast("int").alias("none_negative"))
        out = g if out is None else out.unionByName(g)
    return out


@query("walk_forward_fit")
def walk_forward_fit(spark, sf_dir):
    """Five expanding folds of the lateness model, their dates taken from the row numbers of the walk, fitted anew each time."""
    d = frame(spark, sf_dir, "logistics")
    return M.walk_forward_fit(d, "logistics", M.fold_dates(d))


def _months(df):
    return df.withColumn("period", F.date_format("order_date", "yyyy-MM"))


@query("backtest_monthly_model")
def backtest_monthly_model(spark, sf_dir):
    """The last twelve months as the trained demand model predicts them."""
    return E.backtest_monthly(_months(M.predict(load_model(spark, sf_dir, "demand"), frame(spark, sf_dir, "demand"), "demand")), "p")


@query("forecast_future_model")
def forecast_future_model(spark, sf_dir):
    """Six months ahead by the trained demand model, each month made from the one before."""
    return M.monthly_outlook(M.recursive_forecast(load_frame(spark, sf_dir), load_model(spark, sf_dir, "demand")))


@query("forecast_cells_recursive", sql=with_views("""
    SELECT category, region, CAST(i AS INTEGER) AS horizon, strftime((SELECT max(order_date) FROM oi) + to_months(CAST(i AS INTEGER)), '%Y-%m') AS period, 1 AS possible FROM oi, range(1, 7) t(i) GROUP BY category, region, i"""))
def forecast_cells_recursive(spark, sf_dir):
    """The cells and months of the recursive forecast, and whether each prediction lies in the range of the quantities seen."""
    d = load_frame(spark, sf_dir)
    seen = d.agg(F.struct(F.min("qty").alias("lo"), F.max("qty").alias("hi"))).scalar()
    f = M.recursive_forecast(d, load_model(spark, sf_dir, "demand"))
    return f.select("category", "region", "horizon", "period", F.col("predicted").between(seen["lo"], seen["hi"]).cast("int").alias("possible"))


@query("forecast_one_step", sql=with_views("SELECT category, region, 1 AS same_features, 1 AS same_prediction FROM oi GROUP BY category, region"))
def forecast_one_step(spark, sf_dir):
    """The newest line of each cell scored from its quantities before, against the model on the line's own features."""
    model, t = load_model(spark, sf_dir, "demand"), M.cell_templates(load_frame(spark, sf_dir))
    names = M.FEATURES["demand"]
    own = M.predict(model, t, "demand").select("category", "region", F.col("p").alias("own_p"), *[F.col(n).alias(f"own_{n}") for n in names])
    again = M.predict(model, M.demand_from_history(t.withColumn("day", F.col("order_date"))), "demand").select("category", "region", "p", *names)
    near = [F.abs(F.col(n) - F.col(f"own_{n}")) < 1e-9 for n in names]
    return own.join(again, ["category", "region"]).select("category", "region", F.forall(F.array(*near), lambda x: x).cast("int").alias("same_features"),
                                                          (F.abs(F.col("p") - F.col("own_p")) < 1e-9).cast("int").alias("same_prediction"))


def model_cells(spark, sf_dir):
    """Mean predictions of all three models per category and region of the newest complete month."""
    d = load_frame(spark, sf_dir)
    d = d.where(F.col("period") < d.agg(F.date_format(F.date_add(F.max("order_date"), 1), "yyyy-MM")).scalar())
    d = d.where(F.col("period") == d.agg(F.max("period")).scalar())
    for kind, name in (("demand", "p_qty"), ("supplier", "p_sup"), ("logistics", "p_route")):
        d = M.predict(load_model(spark, sf_dir, kind), d, kind).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("p", name)
    return d


@query("auto_forecast_cells_model")
def auto_forecast_cells_model(spark, sf_dir):
    return E.forecast_cells(model_cells(spark, sf_dir))


@query("graph_aware_forecast_model")
def graph_aware_forecast_model(spark, sf_dir):
    """Combined risk 0.35 / 0.30 / 0.35 of demand deviation, supplier and route risk, all three as predicted by the models."""
    g = model_cells(spark, sf_dir).groupBy("category", "region").agg(
        F.avg(F.least(F.abs(F.col("p_qty") - F.col("qty_roll_30")) / F.greatest("qty_roll_30", F.lit(1.0)), F.lit(1.0))).alias("dr"),
        F.avg("p_sup").alias("sr"), F.avg("p_route").alias("lr"), F.count(F.lit(1)).alias("n"))
    c = 0.35 * F.col("dr") + 0.30 * F.col("sr") + 0.35 * F.col("lr")
    return g.select("category", "region", "n", r(F.col("dr")).alias("demand_risk"), r(c).alias("combined_risk"), risk_label(c).alias("risk_level"))


@query("explain_rows")
def explain_rows(spark, sf_dir):
    """Risk level of each line and the two features that move its own prediction most, with their values and effects, as text."""
    s = M.contributions(load_model(spark, sf_dir, "logistics"), split(frame(spark, sf_dir, "logistics"))[1], "logistics")
    part = lambda i: F.format_string("%s=%.3f (%+.3f)", F.col("parts")[i]["feature"], F.col("parts")[i]["value"], F.col("parts")[i]["effect"])
    return s.select(*KEY, r(F.col("p")).alias("probability"), F.concat(risk_label("p"), F.lit(" risk: "), part(0), F.lit(", "), part(1)).alias("reason"))


@query("model_versions")
def model_versions(spark, sf_dir):
    """Four versions of the lateness model on growing history: saved, scored on the year after, activated, thinned out. The years are the last of the data."""
    d, path, table = frame(spark, sf_dir, "logistics"), work_path(spark, "versions"), None
    newest = d.agg(F.year(F.max("order_date"))).scalar()
    for version in range(1, 5):
        year = newest - 5 + version
        model = M.train(d.where(F.year("order_date") < year), "logistics")
        test = M.predict(model, d.where(F.year("order_date") == year), "logistics")
        metrics = M.classification_metrics(test, "target", "p").select("accuracy", "f1")
        row = M.save_version(model, f"{path}/models", "logistics", version, metrics)
        table = row if table is None else table.unionByName(row)
    table.write.parquet(f"{path}/table")
    kept = M.keep_last(M.activate(spark.read.parquet(f"{path}/table"), "f1"))
    return kept.select("model", "version", "accuracy", "f1", "is_active")
