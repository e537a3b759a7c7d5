"""Node and edge tables of the supply network, aggregated from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightloom.functions.scalars import node_id, normalize_entity
from freightloom.operators.ordered import bottom_k
from freightloom.operators.patterns import DECAY_RATE, MIN_WEIGHT, decay_edges
from freightloom.session import stored_table
from freightloom.sources import GRAPH_COLUMNS, TOTAL_ORDER, order_lines

LABELS = ("Supplier", "Product", "Warehouse", "Shipment", "Customer", "Order", "CalendarEvent")
RELATIONS = ("SUPPLIES", "STORED_IN", "SHIPS_VIA", "DELIVERED_TO", "PLACED", "CONTAINS", "INFLUENCES")
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)


def rows() -> Column:
    return F.count(F.lit(1))


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def named(df: DataFrame) -> DataFrame:
    """Order lines with the entity names the graph is keyed by."""
    return df.withColumns({c: normalize_entity(c) for c in ("department", "category", "city") if c in df.columns})


def extract_suppliers(df: DataFrame) -> DataFrame:
    g = df.groupBy(F.col("department").alias("name")).agg(
        rows().alias("total_orders"), F.avg("late").alias("delay"),
        (F.avg("days_real") - F.avg("days_sched")).alias("days"),
    ).where(F.col("name").isNotNull())
    risk = F.least(F.col("delay") * 0.5 + F.least(F.greatest(F.col("days"), F.lit(0.0)) / 7, F.lit(1.0)) * 0.5, F.lit(1.0))
    return g.select(
        node_id("Supplier", "name").alias("node_id"), "name", rnd(1 - F.col("delay")).alias("reliability"),
        rnd(F.col("delay")).alias("delay_rate"), rnd(1 - F.col("delay")).alias("shipping_efficiency"),
        rnd(F.col("days")).alias("avg_delay_days"), "total_orders", rnd(risk).alias("risk_score"),
    )


def extract_products(df: DataFrame) -> DataFrame:
    """Demand statistics per category; the ends of a category are cut off before the shuffle."""
    def ends(descending: bool, n: int) -> DataFrame:
        by = [F.desc(c) if descending else F.asc(c) for c in TOTAL_ORDER]
        rn = F.row_number().over(Window.partitionBy("category").orderBy(*by))
        return df.withColumn("rn", rn).where(F.col("rn") <= n)

    g = df.groupBy("category").agg(
        rows().alias("n"), F.avg("qty").alias("mean"), F.stddev_samp("qty").alias("sd"), F.avg("late").alias("late")
    )
    last = ends(True, 30).groupBy("category").agg(
        F.avg(F.when(F.col("rn") <= 7, F.col("qty"))).alias("l7"), F.avg("qty").alias("l30")
    )
    first = ends(False, 7).groupBy("category").agg(F.avg("qty").alias("f7"))
    d = g.join(last, "category").join(first, "category")
    r7 = F.when(F.col("n") >= 7, F.col("l7")).otherwise(F.col("mean"))
    r30 = F.when(F.col("n") >= 30, F.col("l30")).otherwise(F.col("mean"))
    slope = F.when(F.col("n") >= 14, F.col("l7") - F.col("f7")).otherwise(0.0)
    vol = F.when(F.col("mean") > 0, F.coalesce(F.col("sd"), F.lit(0.0)) / F.col("mean")).otherwise(0.0)
    d = d.select("category", "late", r7.alias("r7"), r30.alias("r30"), slope.alias("slope"), vol.alias("vol"))
    stress = F.least(F.col("vol") * 0.5 + F.col("late") * 0.5, F.lit(1.0))
    risk = F.least(F.col("vol") * 0.4 + F.col("late") * 0.3 + F.abs("slope") / (F.col("r30") + 1) * 0.3, F.lit(1.0))
    return d.select(
        node_id("Product", "category").alias("node_id"), "category", rnd(F.col("r7")).alias("rolling_7d"),
        rnd(F.col("r30")).alias("rolling_30d"), rnd(F.col("vol")).alias("volatility"),
        rnd(F.col("slope")).alias("trend_slope"), rnd(stress).alias("inventory_stress"), rnd(risk).alias("forecast_risk"),
    )


def extract_warehouses(df: DataFrame) -> DataFrame:
    g = df.groupBy("city").agg(F.min("region").alias("region"), F.avg("late").alias("late"), F.avg("qty").alias("q"))
    d = g.withColumn("stress", F.least(F.col("late") * 0.6 + F.least(F.col("q") / 20, F.lit(1.0)) * 0.4, F.lit(1.0)))
    return d.select(
        node_id("Warehouse", "city").alias("node_id"), "city", "region", rnd(1 - F.col("late")).alias("coverage"),
        rnd(F.col("stress")).alias("stress"), rnd(F.greatest((1 - F.col("stress")) * 30, F.lit(0.0))).alias("days_to_reorder"),
        rnd(F.least(F.col("stress") * 0.7 + F.col("late") * 0.3, F.lit(1.0))).alias("risk"),
    )


def extract_shipments(df: DataFrame) -> DataFrame:
    return df.groupBy("ship_mode").agg(
        rnd(F.avg("days_sched")).alias("scheduled_days"), rnd(F.avg("days_real")).alias("actual_days"),
        rnd(F.avg("days_real") - F.avg("days_sched")).alias("delay"),
        rnd(1 - F.avg("late")).alias("efficiency"), rnd(F.avg("late")).alias("late_rate"),
    ).select(node_id("Shipment", "ship_mode").alias("node_id"), F.col("ship_mode").alias("mode"), "scheduled_days",
             "actual_days", "delay", "efficiency", "late_rate")


def extract_customers(df: DataFrame) -> DataFrame:
    g = df.groupBy("customer_id").agg(
        F.min("segment").alias("segment"), F.min("region").alias("region"), rows().alias("total_orders"),
        rnd(F.avg("sales"), 8).alias("avg_order_value"),
        rnd(F.when(F.sum("sales") > 0, F.sum("profit") / F.sum("sales")).otherwise(0.0)).alias("profit_margin"),
    )
    return g.select(node_id("Customer", "customer_id").alias("node_id"), *g.columns)


def first_lines(df: DataFrame) -> DataFrame:
    """One line per order: its first in the total order, found by the mark `first_line` if the lines bear it."""
    value = [c for c in ("order_date", "sales", "qty", "profit", "late", "customer_id", "category", "ship_mode") if c in df.columns]
    if "first_line" in df.columns:
        return df.where("first_line").select("order_id", *value)
    place = F.struct("line_no", "product_id", "supplier_id", "l_shipdate")
    return df.groupBy("order_id").agg(F.min_by(F.struct(*value), place).alias("v")).select("order_id", "v.*")


def extract_orders(df: DataFrame, strategy: str = "all", size: int = 5000, recent_days: int = 180) -> DataFrame:
    """Order nodes: all orders, the recent ones, or the same number of orders per month."""
    d = first_lines(df)
    if strategy == "recent":
        last = d.agg(F.max("order_date")).scalar()
        d = d.where(F.col("order_date") >= F.date_sub(last, recent_days))
    elif strategy == "stratified":
        d = d.withColumn("month", F.date_format("order_date", "yyyy-MM"))
        per_month = F.greatest(F.lit(1), F.floor(F.lit(size) / d.agg(F.count_distinct("month")).scalar()))
        digest = F.md5(F.concat_ws("|", F.col("order_id").cast("string"), F.lit("42")).cast("binary"))
        d = bottom_k(d, ["month"], per_month, digest)
    elif strategy != "all":
        raise ValueError(f"unknown strategy {strategy}")
    return d.select(
        node_id("Order", "order_id").alias("node_id"), "order_id", "order_date", rnd(F.col("sales"), 2).alias("value"),
        F.col("qty").alias("quantity"), rnd(F.col("profit"), 4).alias("profit"), F.col("late").cast("double").alias("risk_score"),
    )


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)


def extract_calendar(df: DataFrame) -> DataFrame:
    """One node per calendar month seen, and one for weekends."""
    m = df.select(F.month("order_date").alias("m")).distinct()
    months = m.select(
        node_id("CalendarEvent", F.concat(F.lit("month_"), F.col("m").cast("string"))).alias("node_id"),
        month_name(F.col("m")).alias("name"), F.lit("monthly_period").alias("type"), (F.col("m") == 12).cast("int").alias("is_holiday"),
    )
    weekend = df.where(F.weekday("order_date") >= 5).agg(rows().alias("n")).where("n > 0").select(
        node_id("CalendarEvent", F.lit("weekend")).alias("node_id"), F.lit("Weekend").alias("name"),
        F.lit("day_type").alias("type"), F.lit(0).alias("is_holiday"),
    )
    return months.unionByName(weekend)


def _edges(df: DataFrame, rel: str, src: tuple, dst: tuple, strength, frequency, delay=None, confidence: float = 1.0) -> DataFrame:
    return df.select(
        node_id(*src).alias("src"), node_id(*dst).alias("dst"), F.lit(rel).alias("rel_type"),
        F.lit(src[0]).alias("src_label"), F.lit(dst[0]).alias("dst_label"), strength.cast("double").alias("strength"),
        frequency.cast("long").alias("frequency"),
        (F.lit(None) if delay is None else delay).cast("double").alias("avg_delay"), F.lit(confidence).alias("confidence"),
    )


def edges_supplies(df: DataFrame) -> DataFrame:
    g = df.groupBy("department", "category").agg(rows().alias("n"), F.avg("days_real").alias("d"))
    top = g.agg(F.max("n")).scalar()
    return _edges(g, "SUPPLIES", ("Supplier", "department"), ("Product", "category"), rnd(F.col("n") / top), F.col("n"),
                  rnd(F.col("d")), 0.95)


def edges_stored_in(df: DataFrame, top: int = 3) -> DataFrame:
    g = df.groupBy("category", "city").agg(rows().alias("n"))
    rn = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "city"))
    g = g.withColumn("rn", rn).where(F.col("rn") <= top)
    most = g.agg(F.max("n")).scalar()
    return _edges(g, "STORED_IN", ("Product", "category"), ("Warehouse", "city"), rnd(F.col("n") / most), F.col("n"), confidence=0.85)


def edges_ships_via(df: DataFrame) -> DataFrame:
    g = df.select("order_id", "ship_mode").distinct()
    return _edges(g, "SHIPS_VIA", ("Order", "order_id"), ("Shipment", "ship_mode"), F.lit(1.0), F.lit(1))


def edges_delivered_to(df: DataFrame, top: int = 50) -> DataFrame:
    g = df.groupBy("ship_mode", "customer_id").agg(rows().alias("n"), F.avg("days_real").alias("d"))
    rn = F.row_number().over(Window.partitionBy("ship_mode").orderBy(F.desc("n"), "customer_id"))
    g = g.withColumn("rn", rn).where(F.col("rn") <= top)
    return _edges(g, "DELIVERED_TO", ("Shipment", "ship_mode"), ("Customer", "customer_id"),
                  rnd(F.least(F.col("n") / 10, F.lit(1.0))), F.col("n"), rnd(F.col("d")), 0.9)


def edges_per_order(df: DataFrame) -> DataFrame:
    """PLACED, CONTAINS and INFLUENCES, all read from the first line of an order."""
    f = first_lines(df)
    month = F.concat(F.lit("month_"), F.month("order_date").cast("string"))
    one = F.lit(1)
    return (
        _edges(f, "PLACED", ("Customer", "customer_id"), ("Order", "order_id"), F.lit(1.0), one)
        .unionByName(_edges(f, "CONTAINS", ("Order", "order_id"), ("Product", "category"), F.lit(1.0), one))
        .unionByName(_edges(f, "INFLUENCES", ("CalendarEvent", month), ("Order", "order_id"), F.lit(0.7), one, confidence=0.8))
    )


def all_nodes(df: DataFrame) -> DataFrame:
    """Unified node table: node_id, label, name, risk."""
    def unify(nodes: DataFrame, label: str, name: str, risk: Column) -> DataFrame:
        return nodes.select("node_id", F.lit(label).alias("label"), F.col(name).cast("string").alias("name"), risk.cast("double").alias("risk"))

    zero = F.lit(0.0)
    return (
        unify(extract_suppliers(df), "Supplier", "name", F.col("risk_score"))
        .unionByName(unify(extract_products(df), "Product", "category", F.col("forecast_risk")))
        .unionByName(unify(extract_warehouses(df), "Warehouse", "city", F.col("risk")))
        .unionByName(unify(extract_shipments(df), "Shipment", "mode", F.col("late_rate")))
        .unionByName(unify(extract_customers(df), "Customer", "customer_id", zero))
        .unionByName(unify(extract_orders(df), "Order", "order_id", F.col("risk_score")))
        .unionByName(unify(extract_calendar(df), "CalendarEvent", "name", zero))
    )


def all_edges(df: DataFrame) -> DataFrame:
    return (
        edges_supplies(df).unionByName(edges_stored_in(df)).unionByName(edges_ships_via(df))
        .unionByName(edges_delivered_to(df)).unionByName(edges_per_order(df))
    )


def entity_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints exist."""
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi"
    )


def load_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a data set, kept as tables in the shared folder."""
    def lines() -> DataFrame:
        return named(order_lines(spark, sf_dir, *GRAPH_COLUMNS, "first_line"))

    return (
        stored_table(spark, "nodes", sf_dir, lambda: all_nodes(lines())),
        stored_table(spark, "edges", sf_dir, lambda: all_edges(lines())),
    )


INFERRED = "INFERRED"


def inferred_edges(inferred: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """Edges learned from events as they stand on a day, between nodes of the graph: weights decayed to the day, those too light by then or learned later left out.

    `valid_from` is the day of the last pattern, `valid_to` the day from which the edge is too light, were it not seen again (outside the season).
    """
    name = lambda side: F.when(F.col(f"{side}_type").isin("Supplier", "Product", "Warehouse"), normalize_entity(f"{side}_id")).otherwise(F.col(f"{side}_id"))
    known = decay_edges(inferred.where(F.col("last_updated") <= as_of), as_of).where("action <> 'edge_removed'")
    days = F.floor(F.log(MIN_WEIGHT / F.col("weight_before")) / F.log(F.lit(1 - DECAY_RATE))) + 1
    edges = known.select(
        node_id(F.col("source_type"), name("source")).alias("src"), node_id(F.col("target_type"), name("target")).alias("dst"), F.lit(INFERRED).alias("rel_type"),
        F.col("source_type").alias("src_label"), F.col("target_type").alias("dst_label"), F.col("weight").alias("strength"), "frequency", F.lit(None).cast("double").alias("avg_delay"),
        "confidence", F.col("last_updated").alias("valid_from"), F.date_add("last_updated", days.cast("int")).alias("valid_to"))
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def united_edges(edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """Observed and inferred edges in one table; observed ones are valid throughout."""
    none = F.lit(None).cast("date")
    return edges.withColumns({"valid_from": none, "valid_to": none}).unionByName(inferred)
