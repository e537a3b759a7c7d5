"""Model metrics, calibration, comparisons and forecast tables as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions.scalars import clip, ratio, risk_label_3
from freightloom.operators.ordered import ranked, with_position


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def rows() -> Column:
    return F.count(F.lit(1))


def regression_columns(y: str, p: str) -> dict[str, Column]:
    e = F.col(y) - F.col(p)
    mape = F.avg(F.when(F.col(y) != 0, F.abs(e / F.nullif(F.col(y), F.lit(0.0))))) * 100
    r2 = 1 - ratio(F.sum(e * e), F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.avg(y))
    return {"n": rows(), "mae": r(F.avg(F.abs(e))), "rmse": r(F.sqrt(F.avg(e * e))), "mape": r(mape), "r2": r(r2)}


def regression_metrics(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """MAE, RMSE, MAPE over non-zero actuals and R2 in one pass."""
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in regression_columns(y, p).items()])


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5, *by: str) -> DataFrame:
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    g = df.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
    )
    precision = F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    recall = F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return g.select("*", r(ratio(F.col("tp") + F.col("tn"), total)).alias("accuracy"), r(precision).alias("precision"),
                    r(recall).alias("recall"), r(f1).alias("f1"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the curve by ranks: scores are counted first, then ranked over ranges of about equally many scores, however crowded these lie."""
    g = df.groupBy(F.col(p).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    g = ranked(g, ["s"], {"below": F.col("neg")})
    return g.agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
        r(ratio(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg"))).alias("auc"),
    )


def confidence_classes(df: DataFrame, p: str) -> DataFrame:
    c = F.abs(F.col(p) - 0.5) * 2
    level = F.when(c >= 0.7, "high").when(c >= 0.4, "medium").otherwise("low")
    return df.groupBy(level.alias("level")).agg(rows().alias("n"), r(F.avg(c)).alias("mean_confidence"))


def calibration_ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Gap between mean score and observed rate in equal bins, weighted by bin size."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = df.groupBy(b.alias("bin")).agg(rows().alias("n"), F.avg(p).alias("c"), F.avg(y).alias("a"))
    total = g.agg(F.sum("n")).scalar()
    ece = g.agg(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c")))).scalar() / total
    return g.select(F.col("bin").cast("int").alias("bin"), "n", r(F.col("c")).alias("mean_score"), r(F.col("a")).alias("observed"), r(ece).alias("ece"))


def confidence_reg(df: DataFrame, y: str, p: str) -> DataFrame:
    """1 - residual over the largest residual, and the range-based variant that needs no actuals."""
    e = F.abs(F.col(y) - F.col(p))
    s = df.agg(F.struct(F.max(e).alias("e"), F.min(p).alias("lo"), F.max(p).alias("hi"))).scalar()
    by_range = F.when(s["hi"] > s["lo"], 1 - F.abs((F.col(p) - s["lo"]) / (s["hi"] - s["lo"]) - 0.5) * 0.4).otherwise(0.7)
    return df.withColumns({
        "confidence": r(clip(1 - e / F.when(s["e"] > 0, s["e"]).otherwise(1.0), 0.0, 1.0)), "confidence_range": r(clip(by_range, 0.0, 1.0)),
    })


def folds(n: Column, splits: int = 5, min_train: float = 0.5, test: float = 0.1) -> Column:
    """Array of (fold, train_end, test_end) row numbers of the expanding walk."""
    start = F.floor(n * F.lit(min_train))
    size = F.greatest(F.floor(n * F.lit(test)), F.lit(1))
    step = F.greatest(F.floor((n - start) / splits), F.lit(1))
    return F.array(*[
        F.struct(F.lit(i).alias("fold"), (start + step * i).alias("train_end"), F.least(start + step * i + size, n).alias("test_end"))
        for i in range(splits)
    ])


def walk_forward_rows(df: DataFrame, order: list[str], segment: list[str]) -> DataFrame:
    """Rows of each fold's test range: every row gets the folds it is tested in, so no fold rescans the table."""
    n = df.agg(rows()).scalar()
    placed = with_position(df, [], order, segment).withColumn("_n", n).withColumn("_f", F.explode(folds(F.col("_n"))))
    return placed.where((F.col("pos") >= F.col("_f.train_end")) & (F.col("pos") < F.col("_f.test_end"))).select(
        *df.columns, "_f.fold", "_f.train_end"
    )


def mutual_information(df: DataFrame, features: list[str], y: str, bins: int = 20) -> DataFrame:
    """Mutual information (nats) of each feature, cut into equal-width bins, with a 0/1 target."""
    span = df.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in features])).scalar()

    def bin_of(c):
        lo, hi = F.col(f"_span.{c}.lo"), F.col(f"_span.{c}.hi")
        return F.when(hi > lo, F.least(F.floor((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(0)

    cells = df.withColumn("_span", span).select(y, *[bin_of(c).cast("int").alias(c) for c in features]).unpivot(y, features, "feature", "bin")
    g = cells.groupBy("feature", "bin", y).agg(rows().alias("n"))
    w = Window.partitionBy("feature")
    d = g.select("feature", "n", F.sum("n").over(w).alias("t"), F.sum("n").over(Window.partitionBy("feature", "bin")).alias("x"),
                 F.sum("n").over(Window.partitionBy("feature", y)).alias("z"))
    return d.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("x") * F.col("z")))).alias("mi"))


def leakage_audit(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """|Pearson| and mutual information with the target: FAIL above .85 / .55, SUSPECT above .70."""
    corr = df.agg(*[F.abs(F.corr(c, y)).alias(c) for c in features]).unpivot([], features, "feature", "corr")
    c, m = F.col("corr"), F.col("mi")
    verdict = F.when((c > 0.85) | (m > 0.55), "FAIL").when(c > 0.70, "SUSPECT").otherwise("PASS")
    return corr.join(mutual_information(df, features, y), "feature").select("feature", r(c).alias("target_corr"), r(m).alias("mutual_info"), verdict.alias("verdict"))


def deviation_metrics(df: DataFrame, y: str, p: str, threshold: float = 15.0) -> DataFrame:
    pct = F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(y), F.lit(1.0)) * 100
    span = F.max(y) - F.min(y)
    g = df.agg(
        rows().alias("n"), F.avg(pct).alias("m"), F.sqrt(F.avg((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))).alias("e"),
        span.alias("span"), F.count_if(pct > threshold).alias("anomalies"),
    )
    return g.select("n", r(F.col("m")).alias("mape"), r(ratio("e", "span")).alias("nrmse"), "anomalies",
                    ((F.col("m") > threshold) | (F.col("anomalies") > 0)).cast("int").alias("threshold_breach"))


def ab_compare(df: DataFrame, y: str, control: str, treatment: str) -> DataFrame:
    """MAPE and F1 of two prediction columns and the winner at 2 / 5 / 10 % improvement."""
    def mape(p):
        return F.avg(F.abs(F.col(y) - F.col(p)) / F.greatest(F.abs(y), F.lit(1e-6)))

    def f1(p):
        a, b = F.col(p) > 0.5, F.col(y) > 0.5
        tp, wrong = F.count_if(a & b), F.count_if(a != b)
        return F.coalesce(ratio(2 * tp, 2 * tp + wrong), F.lit(0.0))

    g = df.agg(mape(control).alias("cm"), mape(treatment).alias("tm"), f1(control).alias("cf"), f1(treatment).alias("tf"))
    gain = (F.col("cm") - F.col("tm")) / F.greatest("cm", F.lit(1e-6)) * 100
    f1_gain = (F.col("tf") - F.col("cf")) / F.greatest("cf", F.lit(1e-6)) * 100
    winner = F.when(F.abs(gain) < 2, "tie").when(gain > 5, "treatment").otherwise("control")
    sure = F.when(F.abs(gain) < 2, "low").when(F.abs(gain) > 10, "high").otherwise("medium")
    return g.select(r(F.col("cm")).alias("control_mape"), r(F.col("tm")).alias("treatment_mape"), r(F.col("cf")).alias("control_f1"),
                    r(F.col("tf")).alias("treatment_f1"), r(gain, 4).alias("mape_gain_pct"), r(f1_gain, 4).alias("f1_gain_pct"),
                    winner.alias("winner"), sure.alias("confidence"))


def backtest_monthly(df: DataFrame, p: str, months: int = 12) -> DataFrame:
    """Mean prediction of the latest months with 1.96-sigma bounds and a confidence."""
    g = df.groupBy("period").agg(F.avg(p).alias("m"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("s"), rows().alias("n"))
    g = g.orderBy(F.desc("period")).limit(months)
    return g.select("period", "n", r(F.col("m")).alias("predicted"), r(clip(1 - F.col("s") / (F.abs("m") + 1e-6), 0.0, 1.0)).alias("confidence"),
                    r(F.col("m") - 1.96 * F.col("s")).alias("lower"), r(F.col("m") + 1.96 * F.col("s")).alias("upper"))


def forecast_future(df: DataFrame, p: str, horizon: int = 6) -> DataFrame:
    """The last month as template; confidence 0.95^i and bounds widening by 10 % per month ahead."""
    last = df.agg(F.max("period")).scalar()
    g = df.where(F.col("period") == last).agg(F.avg(p).alias("m"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("s"), F.max("order_date").alias("d"))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    wide = 1.96 * F.col("s") * (1 + 0.1 * F.col("i"))
    sure = F.least(F.greatest(1 - F.col("s") / (F.abs("m") + 1e-6), F.lit(0.0)) * F.pow(F.lit(0.95), F.col("i")), F.lit(1.0))
    return g.select(F.date_format(F.add_months("d", F.col("i")), "yyyy-MM").alias("period"), F.col("i").alias("horizon"), r(F.col("m")).alias("predicted"),
                    r(sure).alias("confidence"), r(F.col("m") - wide).alias("lower"), r(F.col("m") + wide).alias("upper"))


def forecast_cells(df: DataFrame, floor: int = 5) -> DataFrame:
    """Per category and region of the template month: mean risks, demand, revenue and the combined risk."""
    last = df.agg(F.max("period")).scalar()
    g = df.where(F.col("period") == last).groupBy("category", "region").agg(
        rows().alias("order_count"), F.avg("p_sup").alias("sr"), F.avg("p_route").alias("lr"), F.avg("p_qty").alias("q"),
        F.avg("sales").alias("d"), F.avg("product_price").alias("price"),
    ).where(F.col("order_count") >= floor)
    parts = [F.when(F.col(c) > 0, F.col(c)) for c in ("sr", "lr")]
    n = sum((x.isNotNull().cast("int") for x in parts), F.lit(0))
    combined = F.coalesce(ratio(sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0)), n), F.lit(0.0))
    return g.select("category", "region", "order_count", r(F.col("sr")).alias("supplier_risk"), r(F.col("lr")).alias("logistics_risk"),
                    r(F.col("q")).alias("predicted_units"), r(F.col("d"), 4).alias("predicted_demand"), r(F.col("d") * F.col("price"), 2).alias("predicted_revenue"),
                    r(combined).alias("combined_risk"), risk_label_3(combined).alias("risk_level"))


def consensus(df: DataFrame, base: dict[str, float]) -> DataFrame:
    """Base weight x accuracy x confidence per agent, normalised, and the weighted overall risk.

    `df` holds one row per agent: agent, accuracy, confidence, risk.
    """
    start = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in base.items() for x in kv]), F.col("agent")), F.lit(0.0))
    d = df.withColumn("effective", start * F.col("accuracy") * F.col("confidence"))
    total = d.agg(F.sum("effective")).scalar()
    d = d.withColumn("weight", F.col("effective") / total)
    return d.select("agent", r(F.col("effective")).alias("effective"), r(F.col("weight")).alias("weight"), r(F.col("risk")).alias("risk"),
                    r(d.agg(F.sum(F.col("weight") * F.col("risk"))).scalar()).alias("overall_risk"))
