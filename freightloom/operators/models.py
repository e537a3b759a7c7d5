"""Tree models on historical features with pyspark.ml: training, scoring, guards and importances."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions.scalars import clip
from freightloom.operators.evaluate import classification_metrics, folds, regression_metrics, roc_auc
from freightloom.operators.features import RANGE, SEGMENT, demand_frames, demand_signals, known, rate_sums, rates
from freightloom.operators.network_features import with_network
from freightloom.operators.ordered import rolling, running
from freightloom.session import checkpoint, shared_folder, written
from freightloom.sources import TOTAL_ORDER

SEED = 42
CALENDAR = ["order_month", "order_quarter", "order_dayofweek", "is_weekend", "is_holiday_period"]
GRAPH_FEATURES = ["graph_supplier_reliability", "graph_inventory_stress", "graph_tpke_edge_density", "graph_avg_shipping_delay"]
# One frozen list per model, shared by training and prediction.
FEATURES = {
    "demand": ["qty_roll_7", "qty_roll_30", "qty_lag_1", "qty_lag_7", "qty_lag_30", "demand_volatility", "demand_spike_flag", "demand_trend_slope",
               "demand_momentum", "price_ratio", "discount_rate", *CALENDAR, *GRAPH_FEATURES],
    "supplier": ["supplier_hist_late_rate", "supplier_reliability_score", "supplier_risk_index", "supplier_order_volume", "supplier_category_diversity", "days_sched",
                 "order_month", "order_quarter", "order_dayofweek", "is_holiday_period", "qty_roll_7", "demand_spike_flag", *GRAPH_FEATURES],
    "logistics": ["shipping_mode_encoded", "route_frequency", "region_congestion_index", "route_hist_late_rate", "region_hist_late_rate", "shipmode_hist_late_rate",
                  "days_sched", "order_value_log", "discount_rate", "order_month", "order_dayofweek", "is_weekend", "is_holiday_period", "qty_roll_7", "demand_spike_flag",
                  *GRAPH_FEATURES],
}
ALL_FEATURES = list(dict.fromkeys(f for names in FEATURES.values() for f in names))
TARGETS = {"demand": "qty", "supplier": "late", "logistics": "late"}
# Columns that contain or follow from the target.
BANNED = {
    "demand": {"qty", "sales", "profit", "order_value", "revenue_per_unit"},
    "supplier": {"late", "days_real", "delivery_gap", "ship_date", "status", "shipping_delay_ratio"},
    "logistics": {"late", "days_real", "delivery_gap", "ship_date", "status", "shipping_delay_ratio"},
}


def check_features(kind: str, features: list[str]) -> None:
    leaks = sorted(set(features) & BANNED[kind])
    if leaks:
        raise ValueError(f"{kind}: banned features {leaks}")


def model_frame(lines: DataFrame, steps: DataFrame) -> DataFrame:
    """Feature columns of the order lines; every one is known when the order is placed.

    Rolling and expanding columns see rows strictly before the row, network columns the weeks before its week. The lines lie by slot. `steps` are the pairs of deviation events.
    """
    groups = {"supplier_hist_late_rate": ["department"], "route_hist_late_rate": ["ship_mode", "region"], "region_hist_late_rate": ["region"], "shipmode_hist_late_rate": ["ship_mode"]}
    needed = ["order_date", "slot", "department", "category", "city", "region", "ship_mode"]
    whole = known(needed)
    one = F.lit(1).cast("long")
    sums = running(lines, TOTAL_ORDER, SEGMENT, [
        *rate_sums("late", groups, needed=needed), ([], {"_price": F.col("product_price"), "_rows": one}, whole), (["ship_mode", "region"], {"_route_rows": one}, whole),
        (["department"], {"_late_qty": F.col("late") * F.col("qty"), "_qty": F.col("qty"), "_own_rows": one}, whole),
    ], laid=RANGE)
    # The rows stay in their slot; what they need from elsewhere comes to the slots.
    part = lines.where(whole)
    d = rolling(rates(sums.where(whole), "late", groups, 30), ["department"], TOTAL_ORDER, SEGMENT, 30, {"_recent": lambda s: F.avg("late").over(s.rowsBetween(-30, -1))}, base=part, laid=RANGE, values=["late"])
    d = with_network(lines, steps, demand_signals(demand_frames(d, base=part, laid=RANGE)), RANGE)
    d = d.withColumns({
        "supplier_order_volume": F.coalesce(F.try_divide("_own_rows", "_rows"), F.lit(0.0)), "route_frequency": F.coalesce(F.try_divide("_route_rows", "_rows"), F.lit(0.0)),
    })
    day = F.weekday("order_date")
    safe = F.when(F.coalesce("qty_roll_30", F.lit(0.0)) == 0, 1.0).otherwise(F.col("qty_roll_30"))
    d = d.withColumns({
        "qty_lag_1": F.coalesce("qty_prev", F.lit(0.0)), "qty_lag_7": F.coalesce("qty_back_7", F.lit(0.0)), "qty_lag_30": F.coalesce("qty_back_30", F.lit(0.0)),
        "demand_trend_slope": F.coalesce(clip((F.col("qty_prev") - F.col("qty_back_7")) / (6 * safe), -2.0, 3.0), F.lit(0.0)),
        "demand_volatility": F.coalesce("demand_volatility", F.lit(0.0)),
        "supplier_reliability_score": 1 - F.coalesce("_recent", F.lit(0.5)),
        "supplier_risk_index": F.coalesce(F.try_divide("_late_qty", "_qty"), F.lit(0.5)),
        "shipping_mode_encoded": F.substring("ship_mode", 1, 1).cast("int"),
        "order_value_log": F.log1p("sales"), "discount_rate": F.coalesce(F.try_divide("discount", "sales"), F.lit(0.0)),
        "order_month": F.month("order_date"), "order_quarter": F.quarter("order_date"), "order_dayofweek": day,
        "is_weekend": (day >= 5).cast("int"), "is_holiday_period": F.month("order_date").isin(10, 11, 12, 1).cast("int"),
    })
    return d.withColumns({
        "qty_roll_7": F.coalesce("qty_roll_7", F.lit(0.0)), "qty_roll_30": F.coalesce("qty_roll_30", F.lit(0.0)),
        "price_ratio": F.coalesce(F.try_divide(F.col("product_price") * F.col("_rows"), "_price"), F.lit(1.0)),
    }).select(*TOTAL_ORDER, "period", "category", "region", "department", "ship_mode", "sales", "product_price", *ALL_FEATURES, "qty", "late")


def prepare_features(df: DataFrame, kind: str) -> DataFrame:
    """Available features and the target, rows with nulls dropped."""
    check_features(kind, FEATURES[kind])
    have = [c for c in FEATURES[kind] if c in df.columns]
    return df.select(*[c for c in ("order_id", "line_no", "product_id", "supplier_id", "l_shipdate", "order_date") if c in df.columns], *have, F.col(TARGETS[kind]).alias("target")).dropna()


def balanced(df: DataFrame) -> DataFrame:
    """Class weight n / (2 x rows of the class)."""
    s = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("target").alias("p"))).scalar()
    return df.withColumn("weight", s["n"] / (2 * F.when(F.col("target") == 1, s["p"]).otherwise(s["n"] - s["p"])))


# The reference settings of the learners. Boosting ends before its last round once the later time slice gains no more than the tolerance.
ROUNDS, BOOST_DEPTH, STEP, TOLERANCE = 500, 7, 0.05, 0.0
TREES, FOREST_DEPTH = 300, 12
FOREST_CELLS = 1 << 28  # rows x trees grown at once: a row in work has two numbers for each of these trees
LATER = 0.15  # share of the fitting days, the latest, that boosting is stopped by


def learner(kind: str, trees: int | None = None, seed: int = SEED):
    common = {"featuresCol": "features", "labelCol": "target", "seed": seed, "cacheNodeIds": True, "checkpointInterval": 10}
    if kind == "supplier":
        return RandomForestClassifier(numTrees=trees or TREES, maxDepth=FOREST_DEPTH, minInstancesPerNode=5, featureSubsetStrategy="sqrt", weightCol="weight", maxMemoryInMB=1024, **common)
    boosted = {"maxIter": ROUNDS, "maxDepth": BOOST_DEPTH, "stepSize": STEP, "minInstancesPerNode": 50, "subsamplingRate": 0.8,
               "validationIndicatorCol": "later", "validationTol": TOLERANCE, "maxMemoryInMB": 1024}
    return GBTRegressor(predictionCol="p", **boosted, **common) if kind == "demand" else GBTClassifier(**boosted, **common)


def with_later(df: DataFrame, share: float = LATER) -> DataFrame:
    """`later`: the row's day is among the latest, which hold about `share` of the rows."""
    days = df.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("order_date"))
    cut = days.withColumn("u", upto).where(F.col("u") >= days.agg(F.sum("n")).scalar() * (1 - share)).agg(F.min("order_date")).scalar()
    return df.withColumn("later", F.col("order_date") > cut)


def tree_groups(rows: int, trees: int) -> list[int]:
    """Sizes of the groups a forest is grown in, as even as can be: rows x trees of a group are FOREST_CELLS at most, or the group is one tree."""
    most = max(FOREST_CELLS // max(rows, 1), 1)
    groups = -(-trees // most)
    return [trees // groups + (k < trees % groups) for k in range(groups)]


def forest(d: DataFrame) -> RandomForestClassificationModel:
    """The forest of the supplier model, its trees grown in groups, each from a seed of its own on all rows; so memory and disk do not grow with rows x trees."""
    whole = learner("supplier")
    groups = tree_groups(d.count(), TREES)
    parts = [learner("supplier", n, SEED + k).fit(d) for k, n in enumerate(groups)]
    if len(parts) == 1:
        return parts[0]
    jvm, gateway = d.sparkSession._jvm.org.apache.spark.ml.classification, d.sparkSession.sparkContext._gateway
    grown = [t for p in parts for t in p._java_obj.trees()]
    array = gateway.new_array(jvm.DecisionTreeClassificationModel, len(grown))
    for k, t in enumerate(grown):
        array[k] = t
    java = jvm.RandomForestClassificationModel(parts[0].uid, array, parts[0].numFeatures, parts[0].numClasses)
    return whole._copyValues(RandomForestClassificationModel(java))


def train(df: DataFrame, kind: str) -> PipelineModel:
    """Fit a model on all rows; the prepared rows are written once, as every round reads them."""
    shared_folder(df.sparkSession)  # names the folder of the checkpoints that cut the rounds' lineage
    d = written(balanced(df) if kind == "supplier" else with_later(df), f"fit-{kind}")
    assembler = VectorAssembler(inputCols=FEATURES[kind], outputCol="features")
    if kind == "supplier":
        return PipelineModel([assembler, forest(assembler.transform(d))])
    return Pipeline(stages=[assembler, learner(kind)]).fit(d)


def predict(model: PipelineModel, df: DataFrame, kind: str) -> DataFrame:
    """Adds column p: predicted quantity, or probability of a late line."""
    out = model.transform(df)
    return out if kind == "demand" else out.withColumn("p", vector_to_array("probability")[1])


def quality(scored: DataFrame, kind: str) -> DataFrame:
    """Metric rows of a model next to those of the trivial predictor (mean or majority)."""
    if kind == "demand":
        mean = scored.agg(F.avg("target")).scalar()
        a = regression_metrics(scored, "target", "p").withColumn("predictor", F.lit("model"))
        return a.unionByName(regression_metrics(scored.withColumn("m", mean), "target", "m").withColumn("predictor", F.lit("mean")))
    m = classification_metrics(scored, "target", "p").withColumn("predictor", F.lit("model"))
    base = classification_metrics(scored.withColumn("m", F.lit(1.0)), "target", "m").withColumn("predictor", F.lit("always_late"))
    return m.withColumn("auc", roc_auc(scored, "target", "p").select("auc").scalar()).unionByName(base.withColumn("auc", F.lit(0.5)))


def importances(model: PipelineModel, kind: str, spark) -> DataFrame:
    """Share of each feature in the model, largest first; its size is that of the feature list."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(kind, n, float(v), "graph" if n in GRAPH_FEATURES else "history") for n, v in zip(FEATURES[kind], values, strict=True)]
    return spark.createDataFrame(rows, "model string, feature string, importance double, feature_group string")


def tautology_guard(df: DataFrame, kind: str, max_auc: float = 0.98) -> DataFrame:
    """AUC of a depth-3 tree: a target a tiny tree can rebuild is leaked by its features."""
    tree = DecisionTreeClassifier(maxDepth=3, featuresCol="features", labelCol="target", seed=SEED)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES[kind], outputCol="features"), tree]).fit(df)
    auc = roc_auc(model.transform(df).withColumn("p", vector_to_array("probability")[1]), "target", "p")
    return auc.select(F.lit(kind).alias("model"), "auc", (F.col("auc") <= max_auc).cast("int").alias("passed"))


def fold_dates(df: DataFrame, splits: int = 5, min_train: float = 0.5, test: float = 0.1) -> list[tuple]:
    """(cut, end) dates of the expanding folds: the days that hold the row numbers at which the folds' test rows begin and end. One row a fold comes to the driver."""
    days = df.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("order_date"))
    total = days.agg(F.sum("n")).scalar()
    placed = days.withColumn("u", upto).withColumn("f", F.explode(folds(total, splits, min_train, test)))
    at = lambda row: F.min(F.when(F.col("u") > F.col(row), F.col("order_date")))
    return [(x["cut"], x["end"]) for x in placed.groupBy("f.fold").agg(at("f.train_end").alias("cut"), at("f.test_end").alias("end")).orderBy("fold").collect()]


def walk_forward_fit(df: DataFrame, kind: str, cuts: list[tuple]) -> DataFrame:
    """Fit per fold on everything before a date and score the days up to the next one (to the last when there is none); metrics unioned."""
    out = None
    for i, (cut, end) in enumerate(cuts):
        model = train(df.where(F.col("order_date") < F.lit(cut)), kind)
        test = df.where(F.col("order_date") >= F.lit(cut))
        test = test if end is None else test.where(F.col("order_date") < F.lit(end))
        m = quality(predict(model, test, kind), kind).withColumn("fold", F.lit(i))
        out = m if out is None else out.unionByName(m)
    return out


def contributions(model: PipelineModel, df: DataFrame, kind: str) -> DataFrame:
    """Adds p and `parts`: for each feature of a row how far p falls when the feature takes its mean over the rows instead, the weightiest first."""
    names = FEATURES[kind]
    means = df.agg(F.struct(*[F.avg(n).alias(n) for n in names])).scalar()
    keep = [F.col(n).cast("double").alias(f"_{n}") for n in names]
    out = predict(model, df.select(*df.columns, *keep), kind).select(*df.columns, *[f"_{n}" for n in names], "p")
    for n in names:
        varied = predict(model, out.withColumnRenamed("p", "_p").withColumn(n, means[n]), kind).drop("features", "rawPrediction", "probability", "prediction")
        out = varied.withColumn(n, F.col(f"_{n}")).withColumnsRenamed({"p": f"_w_{n}", "_p": "p"})
    parts = F.array(*[F.struct(F.abs(F.col("p") - F.col(f"_w_{n}")).alias("size"), F.lit(n).alias("feature"), F.col(f"_{n}").alias("value"), (F.col("p") - F.col(f"_w_{n}")).alias("effect")) for n in names])
    return out.withColumn("parts", F.sort_array(parts, asc=False)).select(*df.columns, "p", "parts")


# -- forecasts that feed on themselves


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _deviation(values: Column) -> Column:
    m = _mean(values)
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(values) >= 2, F.sqrt(spread / (F.size(values) - 1))).otherwise(0.0)


def demand_from_history(df: DataFrame, history: str = "history", day: str = "day") -> DataFrame:
    """The demand features a row on `day` has when `history` holds the quantities before it, newest first (30 at most)."""
    h = F.col(history)
    back = lambda n: F.coalesce(F.try_element_at(h, F.lit(n)), F.lit(0.0))
    known = lambda n: F.try_element_at(h, F.lit(n))
    m7, m30 = _mean(F.slice(h, 1, 7)), _mean(h)
    safe = F.when(F.coalesce(m30, F.lit(0.0)) == 0, 1.0).otherwise(m30)
    weekday = F.weekday(day)
    return df.withColumns({
        "qty_roll_7": F.coalesce(m7, F.lit(0.0)), "qty_roll_30": F.coalesce(m30, F.lit(0.0)), "qty_lag_1": back(1), "qty_lag_7": back(7), "qty_lag_30": back(30),
        "demand_volatility": clip(_deviation(h) / safe, 0.0, 5.0), "demand_momentum": F.when(m7.isNull(), 1.0).otherwise(clip(m7 / safe, 0.0, 3.0)),
        "demand_spike_flag": F.coalesce(known(1) > m7 + 2 * _deviation(F.slice(h, 1, 14)), F.lit(False)).cast("int"),
        "demand_trend_slope": F.coalesce(clip((known(1) - known(7)) / (6 * safe), -2.0, 3.0), F.lit(0.0)),
        "order_month": F.month(day), "order_quarter": F.quarter(day), "order_dayofweek": weekday, "is_weekend": (weekday >= 5).cast("int"),
        "is_holiday_period": F.month(day).isin(10, 11, 12, 1).cast("int"),
    })


def cell_templates(frame: DataFrame, newest: int = 30) -> DataFrame:
    """One row per category and region: its latest line's features, date and quantity, and the quantities before that line, newest first."""
    w = Window.partitionBy("category", "region").orderBy(*[F.desc(c) for c in TOTAL_ORDER])
    last = frame.withColumn("_rn", F.row_number().over(w)).where(f"_rn <= {newest + 1}")
    rest = [c for c in FEATURES["demand"]]
    row = F.struct("order_date", F.col("qty").cast("double").alias("qty"), *rest)
    g = last.groupBy("category", "region").agg(F.min_by(row, "_rn").alias("t"), F.array_sort(F.collect_list(F.struct("_rn", F.col("qty").cast("double").alias("q")))).alias("h"))
    return g.select("category", "region", "t.*", F.transform(F.slice("h", 2, newest), lambda x: x["q"]).alias("history"))


def recursive_forecast(frame: DataFrame, model: PipelineModel, horizon: int = 6, newest: int = 30) -> DataFrame:
    """category, region, horizon, period, predicted, spread: demand by month after the table's last day, each prediction being the newest quantity the next one is made from.

    A cell's state is its latest line and `newest` quantities, so a step scores one row per cell, however many lines there are.
    """
    newest_day = frame.agg(F.max("order_date")).scalar()
    state = cell_templates(frame, newest).withColumns({"history": F.slice(F.concat(F.array("qty"), F.col("history")), 1, newest), "order_date": newest_day})
    state = checkpoint(state)
    out = None
    for i in range(1, horizon + 1):
        ahead = demand_from_history(state.withColumn("day", F.add_months("order_date", i)))
        scored = predict(model, ahead, "demand")
        state = checkpoint(scored.withColumn("history", F.slice(F.concat(F.array("p"), F.col("history")), 1, newest)).select(*state.columns, "day", F.col("p").alias("predicted")))
        step = state.select("category", "region", F.lit(i).alias("horizon"), F.date_format("day", "yyyy-MM").alias("period"), "predicted", _deviation(F.col("history")).alias("spread"))
        out = step if out is None else out.unionByName(step)
        state = state.drop("day", "predicted")
    return out


def monthly_outlook(forecast: DataFrame) -> DataFrame:
    """Mean over the cells per month ahead; confidence 0.95^i and bounds that widen by 10 % per month."""
    g = forecast.groupBy("period", "horizon").agg(F.avg("predicted").alias("m"), F.coalesce(F.stddev_pop("predicted"), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("cells"))
    sure = F.least(F.greatest(1 - F.col("s") / (F.abs("m") + 1e-6), F.lit(0.0)) * F.pow(F.lit(0.95), F.col("horizon")), F.lit(1.0))
    wide = 1.96 * F.col("s") * (1 + 0.1 * F.col("horizon"))
    return g.select("period", "horizon", "cells", F.round("m", 6).alias("predicted"), F.round(sure, 6).alias("confidence"),
                    F.round(F.col("m") - wide, 6).alias("lower"), F.round(F.col("m") + wide, 6).alias("upper"))


def save_version(model: PipelineModel, path: str, kind: str, version: int, metrics: DataFrame) -> DataFrame:
    """Save a fitted pipeline under its version and return its row of the version table."""
    where = f"{path}/{kind}/v{version}"
    model.write().overwrite().save(where)
    return metrics.select(F.lit(kind).alias("model"), F.lit(version).alias("version"), F.lit(where).alias("path"), "*")


def activate(versions: DataFrame, score: str) -> DataFrame:
    """The best scored version of each model becomes active; the newest wins a tie."""
    best = versions.groupBy("model").agg(F.max_by("version", F.struct(score, "version")).alias("best"))
    return versions.join(best, "model").withColumn("is_active", (F.col("version") == F.col("best")).cast("int")).drop("best")


def rollback(versions: DataFrame, version: int) -> DataFrame:
    return versions.withColumn("is_active", (F.col("version") == version).cast("int"))


def keep_last(versions: DataFrame, n: int = 3) -> DataFrame:
    """Only the newest `n` versions of each model, and the active one, stay."""
    newer = Window.partitionBy("model").orderBy(F.desc("version"))
    return versions.withColumn("_rn", F.row_number().over(newer)).where(f"_rn <= {n} OR is_active = 1").drop("_rn")
