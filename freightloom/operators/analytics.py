"""Breakdowns, risk tables, trends and KPI rows over the order lines.

Every function groups first (map-side combine) and derives ratios from the grouped rows. Shares and
other global figures come from scalar subqueries over the grouped rows, not from an
unpartitioned window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.functions.scalars import clip, ratio, risk_label_3


def rows() -> Column:
    return F.count(F.lit(1))


def delay() -> Column:
    return F.col("days_real") - F.col("days_sched")


def r(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits)


def period_table(df: DataFrame, period: str) -> DataFrame:
    """Orders, sales, profit, lateness per period; the late rate both per order and per row."""
    g = df.groupBy(period).agg(
        F.count_distinct("order_id").alias("total_orders"),
        rows().alias("total_rows"),
        r(F.sum("sales"), 2).alias("total_sales"),
        r(F.avg("profit"), 4).alias("avg_profit"),
        F.sum("late").alias("late_delivery_count"),
        F.sum("qty").cast("long").alias("total_items"),
        r(F.avg("days_real")).alias("avg_shipping_days"),
        r(F.avg("days_sched")).alias("avg_scheduled_days"),
        F.count_distinct(F.when(F.col("late") == 1, F.col("order_id"))).alias("late_orders"),
    )
    return g.select(
        "*",
        r(ratio("late_delivery_count", "total_orders")).alias("late_delivery_rate"),
        r(ratio("late_delivery_count", "total_rows")).alias("late_rate_rows"),
        r(ratio("late_orders", "total_orders")).alias("late_rate_orders"),
    )


def late_breakdown(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        rows().alias("order_count"),
        r(F.avg("late")).alias("late_rate"),
        r(F.avg(delay())).alias("avg_delay"),
    )


def mode_breakdown(df: DataFrame) -> DataFrame:
    g = late_breakdown(df, "ship_mode")
    return g.withColumn("pct", r(F.col("order_count") / g.agg(F.sum("order_count")).scalar() * 100))


def status_breakdown(df: DataFrame) -> DataFrame:
    g = df.groupBy("status").agg(rows().alias("n"))
    return g.withColumn("pct", r(F.col("n") / g.agg(F.sum("n")).scalar() * 100))


def supplier_reliability(df: DataFrame) -> DataFrame:
    g = df.groupBy("department").agg(
        rows().alias("order_count"), F.sum("late").alias("late_count"), F.avg(delay()).alias("_delay")
    )
    g = g.withColumn("_rel", 1 - F.col("late_count") / F.col("order_count"))
    return g.select(
        "department", "order_count", "late_count",
        r(F.col("_rel")).alias("reliability"),
        r(F.col("_delay")).alias("avg_delay"),
        r(g.agg(F.avg("_rel")).scalar()).alias("avg_reliability"),
    )


def category_volatility(df: DataFrame, top: int = 15) -> DataFrame:
    g = df.groupBy("category").agg(
        F.stddev_samp("qty").alias("_sd"), F.avg("qty").alias("_mean"),
        F.avg("late").alias("_late"), rows().alias("order_count"),
    )
    spread = clip(F.col("_sd") / F.when(F.col("_mean") == 0, 1.0).otherwise(F.col("_mean")), 0.0, 1.0)
    return (
        g.select("category", r(spread).alias("score"), r(F.col("_late")).alias("late_rate"), "order_count")
        .orderBy(F.desc("score"), "category").limit(top)
    )


def value_brackets(df: DataFrame) -> DataFrame:
    """Rows per sales bracket, 50 / 200 / 500 being the bounds."""
    s = F.col("sales")
    bracket = F.when(s < 50, "low").when(s < 200, "medium").when(s < 500, "high").otherwise("premium")
    return df.where(s.isNotNull()).groupBy(bracket.alias("bracket")).agg(rows().alias("n"))


def risk_heatmap(df: DataFrame, floor: int = 20, top: int = 100) -> DataFrame:
    g = df.groupBy("category", "region").agg(
        F.avg("late").alias("late_rate"), F.avg(delay()).alias("_delay"), rows().alias("order_count")
    ).where(F.col("order_count") >= floor)
    return (
        g.select(
            "category", "region", r(F.col("late_rate")).alias("score"),
            r(F.col("late_rate") * 0.9).alias("demand_risk"),
            r(F.col("late_rate") * 0.85).alias("inventory_risk"),
            r(F.col("late_rate") * 1.05).alias("supplier_risk"),
            r(F.least(F.col("_delay") / 3, F.lit(1.0))).alias("logistics_risk"),
            "order_count",
        ).orderBy(F.desc("score"), "category", "region").limit(top)
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("period").agg(
        rows().alias("orders"), F.sum("late").alias("late_orders"),
        r(F.avg("late")).alias("late_rate"), r(F.avg(delay())).alias("avg_delay"),
        r(F.sum("sales"), 2).alias("total_sales"), F.sum("qty").cast("long").alias("total_qty"),
    )


def global_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        rows().alias("total_orders"), F.sum("late").alias("late_count"),
        r(F.avg("late") * 100).alias("late_pct"), r(F.avg(delay())).alias("avg_delay"),
        F.min("order_date").alias("date_min"), F.max("order_date").alias("date_max"),
    )


def entity_risk(df: DataFrame, entity: str, top: int = 50) -> DataFrame:
    """The `top` entities by volume with risk 0.7 late + 0.3 delay, SLA, lead time and exposure."""
    g = df.groupBy(F.col(entity).alias("entity")).agg(
        rows().alias("total_orders"), F.sum("late").alias("late_orders"), F.avg(delay()).alias("avg_delay"),
        F.sum("sales").alias("_sales"),
    ).orderBy(F.desc("total_orders"), "entity").limit(top)
    late = F.col("late_orders") / F.col("total_orders")
    risk = clip(late * 0.7 + F.least(F.col("avg_delay") / 5, F.lit(1.0)) * 0.3, 0.01, 0.99)
    return g.select(
        "entity", "total_orders", "late_orders",
        r(risk).alias("risk"),
        r(clip((1 - late * 0.35) * 100, 50.0, 99.0)).alias("forecast_accuracy"),
        r(F.greatest(F.col("avg_delay") + 2.5, F.lit(0.5))).alias("lead_time"),
        r(clip((1 - late) * 100, 50.0, 100.0)).alias("sla"),
        r(F.col("_sales"), 2).alias("total_sales"),
        r(F.col("_sales") * risk, 2).alias("business_impact"),
    )


def normalized_weighted_risk(df: DataFrame, entity: str, top: int = 50) -> DataFrame:
    g = entity_risk(df, entity, top).select("entity", "risk")
    return g.withColumn("normalized_risk", r(F.col("risk") / F.sum("risk").over(Window.partitionBy(F.lit(1))) * 100))


def entity_kpis(df: DataFrame, entity: str) -> DataFrame:
    """KPI cards of every value of one dimension (degree comes from the graph tables)."""
    g = df.groupBy(F.col(entity).alias("entity")).agg(
        rows().alias("total_orders"), F.avg("late").alias("_late"), F.avg(delay()).alias("_delay"),
        F.sum("sales").alias("_sales"),
    )
    pct = F.col("_late") * 100
    return g.select(
        "entity", "total_orders", r(pct).alias("risk_pct"), r(100 - pct).alias("sla_pct"),
        r(clip(100 - pct * 0.3, 65.0, 98.5)).alias("forecast_accuracy_pct"),
        r(F.col("_sales") * F.col("_late"), 2).alias("financial_exposure"),
        r(F.greatest(F.col("_delay"), F.lit(0.2))).alias("lead_time_delay"),
        r(F.col("_sales") * 0.15, 2).alias("business_impact"),
    )


def lead_time_anomaly(df: DataFrame) -> DataFrame:
    """Months whose lead time exceeds mean + 1.5 population deviations of the monthly values."""
    m = df.groupBy("period").agg(r(F.greatest(F.avg(delay()) + 2.0, F.lit(0.5))).alias("lead_time"))
    bound = m.agg((F.avg("lead_time") + 1.5 * F.stddev_pop("lead_time")).alias("b")).scalar()
    return m.select("period", "lead_time", (F.col("lead_time") > bound).cast("int").alias("is_anomaly"))


def error_diagnostics(cells: DataFrame, floor: int = 5, top: int = 10) -> DataFrame:
    """Largest (category, region) cells: predicted against actual demand and the class responsible."""
    g = cells.where(F.col("order_count") >= floor).orderBy(F.desc("order_count"), "category", "region").limit(top)
    gap = F.col("actual_demand") - F.col("predicted_demand")
    level = risk_label_3(F.col("late_rate"), 0.55, 0.35)
    return g.select(
        "category", "region", "order_count",
        r(F.col("predicted_demand"), 4).alias("predicted_demand"), "actual_demand",
        r(gap / (F.col("predicted_demand") + 1e-6) * 100).alias("variance_pct"),
        r(F.col("late_rate")).alias("late_rate"), level.alias("risk_level"),
        F.when(level == "high", "logistics").when(level == "medium", "supplier").otherwise("demand").alias("responsible"),
    )


def group_target_mean(df: DataFrame, key: str, target: str) -> DataFrame:
    """Mean target of the whole frame per key, mapped back to the rows (reporting only)."""
    means = df.groupBy(key).agg(r(F.avg(target)).alias("target_mean"))
    return df.join(means, key)


def incident_impact(df: DataFrame, key: str, loss_factor: float = 0.12) -> DataFrame:
    late = F.col("late") == 1
    return df.groupBy(key).agg(
        r(F.sum("sales") * F.avg("late") * loss_factor, 2).alias("estimated_loss"),
        F.count_distinct(F.when(late, F.col("order_id"))).alias("affected_orders"),
        F.count_distinct(F.when(late, F.col("customer_id"))).alias("affected_customers"),
    )
