"""The order-line table every operator works on, built from the given parquet tables.

Only the tables whose columns are asked for are joined. All foreign keys of the inner joins hold, so
leaving out a table does not change the rows; it saves a shuffle of the fact side. The join
strategy is left to Catalyst, which broadcasts a side only under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freightloom.session import has_stored, prepare, rows_known, sized, stored_buckets, stored_table, written

LARGE = ("lineitem", "events")
TOTAL_ORDER = ["order_date", "order_id", "line_no", "product_id", "supplier_id", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return sized(found, f"{sf_dir}/{name}") if name in LARGE else found


def _days_sched():
    return F.expr(
        "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 4 END"
    )


def _days_real():
    return F.expr("CAST(pmod(datediff(l_shipdate, o_orderdate), 7) AS INT)")


# column -> (expression, tables it needs besides lineitem)
_COLUMNS = {
    "order_id": (lambda: F.col("l_orderkey"), ""),
    "line_no": (lambda: F.col("l_linenumber"), ""),
    "order_date": (lambda: F.to_date("o_orderdate"), "orders"),
    "days_real": (_days_real, "orders"),
    "days_sched": (_days_sched, "orders"),
    "late": (lambda: (_days_real() > _days_sched()).cast("int"), "orders"),
    "ship_date": (lambda: F.date_add(F.to_date("o_orderdate"), _days_real()), "orders"),
    "department": (lambda: F.col("s_name"), "supplier"),
    "supplier_id": (lambda: F.col("l_suppkey"), ""),
    "category": (lambda: F.col("p_type"), "part"),
    "product_id": (lambda: F.col("l_partkey"), ""),
    "product_price": (lambda: F.col("p_retailprice"), "part"),
    "ship_mode": (lambda: F.col("o_orderpriority"), "orders"),
    "region": (lambda: F.col("r_name"), "orders customer nation region"),
    "city": (lambda: F.col("n_name"), "orders customer nation"),
    "customer_id": (lambda: F.col("o_custkey"), "orders"),
    "segment": (lambda: F.col("c_mktsegment"), "orders customer"),
    "qty": (lambda: F.col("l_quantity"), ""),
    "sales": (lambda: F.col("l_extendedprice"), ""),
    "discount": (lambda: F.col("l_discount") * F.col("l_extendedprice"), ""),
    "profit": (
        lambda: F.col("l_extendedprice") * (1 - F.col("l_discount"))
        - F.col("l_quantity") * F.col("p_retailprice") * 0.5,
        "part",
    ),
    "status": (lambda: F.concat("l_returnflag", "l_linestatus"), ""),
    "l_shipdate": (lambda: F.to_date("l_shipdate"), ""),
    "period": (lambda: F.date_format("o_orderdate", "yyyy-MM"), "orders"),
}

def order_items(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The canonical order lines with the named columns (all when none is named)."""
    wanted = list(columns) or list(_COLUMNS)
    needs = {name for c in wanted for name in _COLUMNS[c][1].split()}
    rows = table(spark, sf_dir, "lineitem")
    if "part" in needs:  # first, as the rows are narrower before the orders' columns
        part = table(spark, sf_dir, "part")
        rows = rows.join(part, rows.l_partkey == part.p_partkey)
    if "orders" in needs:
        orders = table(spark, sf_dir, "orders")
        if "customer" in needs:
            place = table(spark, sf_dir, "customer")
            if "nation" in needs:
                nation = table(spark, sf_dir, "nation")
                if "region" in needs:
                    region = table(spark, sf_dir, "region")
                    nation = nation.join(region, nation.n_regionkey == region.r_regionkey)
                place = place.join(nation, place.c_nationkey == nation.n_nationkey)
            orders = orders.join(place, orders.o_custkey == place.c_custkey)
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey)
    if "supplier" in needs:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        rows = rows.join(supplier, rows.l_suppkey == supplier.s_suppkey)
    return rows.select(*[_COLUMNS[c][0]().alias(c) for c in wanted])


# The columns windowed features and scores read, and those of the graph; each set is kept apart from the full copy, which is several times as wide.
FEATURE_COLUMNS = [*TOTAL_ORDER, "period", "category", "region", "city", "department", "ship_mode", "segment", "discount", "qty", "late", "sales", "product_price", "days_sched", "days_real"]
GRAPH_COLUMNS = ["order_id", "line_no", "order_date", "days_real", "days_sched", "late", "department", "category", "ship_mode", "region", "city", "customer_id",
                 "segment", "qty", "sales", "profit", "product_id", "supplier_id", "l_shipdate", "period"]
SLOT_ROWS = 50_000
DAY_PARTS = 64  # a day with more rows than a slot is cut into so many parts at most


def in_slots(rows: DataFrame, orders: DataFrame, slots: int) -> DataFrame:
    """rows with `slot`, the number of their range in the total order, without a shuffle: ranges hold about equally many of `orders` (order_date, order_id).

    Days are counted; a day with more orders than a range is cut at quantiles of its order ids. Rows without a date, which come first, are in slot 0.
    """
    days = orders.where("order_date IS NOT NULL").groupBy("order_date").agg(F.count(F.lit(1)).alias("_n"))
    days = written(days, "days")  # one row a day
    total = days.agg(F.sum("_n")).scalar()
    crowded = days.where(F.col("_n") * slots > total).select("order_date")
    parts = orders.join(F.broadcast(crowded), "order_date", "left_semi").groupBy("order_date").agg(
        F.percentile_approx("order_id", [i / DAY_PARTS for i in range(1, DAY_PARTS)], 10_000).alias("_bounds"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("order_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("order_date", "_n", before.alias("_before"), total.alias("_total")).join(parts, "order_date", "left")
    part = F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col("order_id"))))
    slot = F.floor((F.col("_before") + F.col("_n") * part / DAY_PARTS) * slots / F.col("_total"))
    return rows.join(F.broadcast(days), "order_date", "left").select(*rows.columns, F.coalesce(slot, F.lit(0)).cast("int").alias("slot"))


def with_first_lines(rows: DataFrame) -> DataFrame:
    """rows with `first_line`, which marks the first line of each order. Joined rows lie by order, so this needs no shuffle of its own."""
    place = Window.partitionBy("order_id").orderBy("line_no", "product_id", "supplier_id", "l_shipdate")
    return rows.withColumn("first_line", F.row_number().over(place) == 1)


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The order lines with the named columns (all but the following two when none is named), joined once per application and kept in the shared folder.

    `slot`, if named, is the number of a row's range. Ranges hold about equally many rows and follow the total order, so (order_date, slot) cuts a crowded
    day into pieces whatever its order ids are; the rows of a slot lie together. `first_line`, if named, marks the line of an order that is first in the total
    order. For jobs that read the lines many times (graph building, scoring) or need slots; a job that reads them once should name its columns in order_items
    instead and let the scan be pruned.
    """
    wanted = set(columns or _COLUMNS)

    def kept(names: list[str]) -> DataFrame:
        return order_items(spark, sf_dir, *[c for c in names if c != "period"])

    def slots() -> int:
        return max(-(-(rows_known(spark, f"{sf_dir}/lineitem") or 0) // SLOT_ROWS), 1)

    def slotted(names: list[str]) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("order_date"), F.col("o_orderkey").alias("order_id"))
        return in_slots(kept(names), orders, slots())

    if "first_line" in wanted or ("slot" not in wanted and wanted <= set(GRAPH_COLUMNS) and not (wanted <= set(FEATURE_COLUMNS) and has_stored(spark, "feature_lines", sf_dir))):
        lines = stored_table(spark, "graph_lines", sf_dir, lambda: with_first_lines(kept(GRAPH_COLUMNS)))
    elif wanted <= {*FEATURE_COLUMNS, "slot"}:
        lines = stored_buckets(prepare(spark), "feature_lines", sf_dir, "slot", lambda: slotted(FEATURE_COLUMNS), slots)
    else:
        lines = stored_buckets(prepare(spark), "order_lines", sf_dir, "slot", lambda: slotted(list(_COLUMNS)), slots)
    lines = lines.withColumn("period", F.date_format("order_date", "yyyy-MM"))
    return lines.select(*(columns or _COLUMNS))


def known_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the order lines, from lines the application keeps already if they have them, joined otherwise."""
    kept = any(set(columns) <= set(names) and has_stored(spark, name, sf_dir) for name, names in (("feature_lines", FEATURE_COLUMNS), ("graph_lines", GRAPH_COLUMNS)))
    return order_lines(spark, sf_dir, *columns) if kept else order_items(spark, sf_dir, *columns)


_REAL = "CAST(((date_diff('day', o_orderdate::date, l_shipdate::date) % 7) + 7) % 7 AS INTEGER)"
_SCHED = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 4 END"

# The same view for the SQL check.
ORDER_ITEMS_SQL = f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_orderdate::date AS order_date,
  {_REAL} AS days_real, {_SCHED} AS days_sched,
  CASE WHEN {_REAL} > {_SCHED} THEN 1 ELSE 0 END AS late,
  CAST(o_orderdate::date + {_REAL} AS DATE) AS ship_date,
  s_name AS department, l_suppkey AS supplier_id, p_type AS category, l_partkey AS product_id,
  p_retailprice AS product_price, o_orderpriority AS ship_mode, r_name AS region, n_name AS city,
  c_custkey AS customer_id, c_mktsegment AS segment, l_quantity AS qty, l_extendedprice AS sales,
  l_discount * l_extendedprice AS discount,
  l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice * 0.5 AS profit,
  l_returnflag || l_linestatus AS status, l_shipdate::date AS l_shipdate,
  strftime(o_orderdate, '%Y-%m') AS period
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
