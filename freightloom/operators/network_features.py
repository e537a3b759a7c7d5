"""Features of order lines taken from the network as it was known before the line's week.

What the network knew is kept as weekly snapshots: totals per edge (supplier and category, category and city, mode and region) and week are summed up over
the weeks before, so a snapshot grows by one week and no line is read twice. Snapshots are small (edges times weeks with activity) and are joined to
the lines by key and week; all rows of a week see the same snapshot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.session import written

RECENT_WEEKS = 4


def all_weeks(df: DataFrame, keys: Sequence[str], week: str = "week") -> DataFrame:
    """Every combination of the keys seen, for every week from the first to the last of the table."""
    span = df.agg(F.struct(F.min(week).alias("lo"), F.max(week).alias("hi"))).scalar()
    return df.select(*keys).distinct().withColumn(week, F.explode(F.sequence(span["lo"], span["hi"], F.expr("INTERVAL 7 DAYS"))))


def so_far(df: DataFrame, keys: Sequence[str], measures: Sequence[str], weeks: int | None = None) -> DataFrame:
    """Sums over the weeks before (the last `weeks` of them) of a table with one row per key and week."""
    back = Window.unboundedPreceding if weeks is None else -weeks
    w = Window.partitionBy(*keys).orderBy("week").rowsBetween(back, -1)
    return df.select(*keys, "week", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(m) for m in measures])


def traded_weeks(lines: DataFrame, laid: Sequence[str]) -> DataFrame:
    """department, category, week, the columns `laid` (by which the lines lie): n and l, lines and late lines of the pair before the week, and `first`, which marks the pair's first week once."""
    own = lines.groupBy("department", "category", "week", *laid).agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("l"))
    pair = Window.partitionBy("department", "category")
    before = pair.orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_day", F.datediff("week", F.lit("1970-01-01").cast("date")))
    first = (F.row_number().over(pair.orderBy(F.asc_nulls_last("_day"), *laid)) == 1) & F.col("week").isNotNull()
    return own.select("department", "category", "week", *laid, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in "nl"], first.alias("first"))


def category_totals(lines: DataFrame) -> DataFrame:
    """category, week: lines and late lines of the category before the week."""
    whole = lines.groupBy("category", "week").agg(F.count(F.lit(1)).alias("all_n"), F.sum("late").alias("all_l"))
    return so_far(whole, ["category"], ["all_n", "all_l"])


def peer_reliability() -> Column:
    """Share on time among the lines of the other suppliers of the category, from the figures of traded_weeks and category_totals; half when none is known."""
    return F.coalesce(1 - F.try_divide(F.col("all_l") - F.col("l"), F.col("all_n") - F.col("n")), F.lit(0.5))


def supplier_breadth(lines: DataFrame, traded: DataFrame, weeks: DataFrame) -> DataFrame:
    """department, week: categories the supplier delivered before the week, over all categories known before it. `traded` is traded_weeks, `weeks` has department, week."""
    first = traded.where("first").groupBy("department", "week").agg(F.count(F.lit(1)).alias("n"))
    seen = weeks.join(first, ["department", "week"], "left").fillna(0, ["n"])
    known = lines.groupBy("category").agg(F.min("week").alias("week")).groupBy("week").agg(F.count(F.lit(1)).alias("n_all"))
    total = so_far(lines.select("week").distinct().join(known, "week", "left").fillna(0, ["n_all"]).withColumn("one", F.lit(1)), ["one"], ["n_all"])
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("n_all")), F.lit(0.0))
    return so_far(seen, ["department"], ["n"]).join(total, "week").select("department", "week", share.alias("supplier_category_diversity"))


def linked_stress(lines: DataFrame) -> DataFrame:
    """category, week: stress of the warehouses (cities) the category is linked with, weighted by the lines that link them.

    A warehouse's stress is the quantity of the week before over its weekly mean of the last four weeks, at most 3.
    """
    weekly = lines.groupBy("category", "city", "week").agg(F.sum("qty").alias("q"), F.count(F.lit(1)).alias("n"))
    city = weekly.groupBy("city", "week").agg(F.sum("q").alias("q"))
    city = all_weeks(city, ["city"]).join(city, ["city", "week"], "left").fillna(0, ["q"])
    w = Window.partitionBy("city").orderBy("week")
    stress = F.least(F.coalesce(F.try_divide(F.lag("q").over(w), F.avg("q").over(w.rowsBetween(-RECENT_WEEKS, -1))), F.lit(1.0)), F.lit(3.0))
    links = all_weeks(weekly, ["category", "city"]).join(weekly.select("category", "city", "week", "n"), ["category", "city", "week"], "left").fillna(0, ["n"])
    known = so_far(links, ["category", "city"], ["n"]).join(city.select("city", "week", stress.alias("s")), ["city", "week"])
    mean = F.try_divide(F.sum(F.col("n") * F.col("s")), F.sum("n"))
    return known.groupBy("category", "week").agg(F.coalesce(mean, F.lit(1.0)).alias("graph_inventory_stress"))


def neighbour_routes(lines: DataFrame) -> DataFrame:
    """ship_mode, region, week: late share of the routes that share the mode or the region, without the route itself; half when none is known."""
    weekly = lines.groupBy("ship_mode", "region", "week").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("l"))
    grid = all_weeks(weekly, ["ship_mode", "region"]).join(weekly, ["ship_mode", "region", "week"], "left").fillna(0, ["n", "l"])
    known = so_far(grid, ["ship_mode", "region"], ["n", "l"])
    near = lambda c: sum((F.sum(c).over(Window.partitionBy(k, "week")) for k in ("ship_mode", "region")), F.lit(0)) - 2 * F.col(c)
    return known.select("ship_mode", "region", "week", F.coalesce(F.try_divide(near("l"), near("n")), F.lit(0.5)).alias("graph_avg_shipping_delay"))


def region_load(lines: DataFrame) -> DataFrame:
    """region, week: lines of the week before over the weekly mean of the last four, at most 3."""
    weekly = lines.groupBy("region", "week").agg(F.count(F.lit(1)).alias("n"))
    grid = all_weeks(weekly, ["region"]).join(weekly, ["region", "week"], "left").fillna(0, ["n"])
    w = Window.partitionBy("region").orderBy("week")
    load = F.coalesce(F.try_divide(F.lag("n").over(w).cast("double"), F.avg("n").over(w.rowsBetween(-RECENT_WEEKS, -1))), F.lit(1.0))
    return grid.select("region", "week", F.least(load, F.lit(3.0)).alias("region_congestion_index"))


def inferred_density(steps: DataFrame, weeks: DataFrame) -> DataFrame:
    """department, week: event links (A then B) that touch the supplier and were complete in the four weeks before, over the largest such number of the week.

    A link is known once the week of its second event is over. `weeks` has department, week.
    """
    ends = F.array(*[F.struct(F.col(f"{s}_entity_type").alias("t"), F.col(f"{s}_entity_id").alias("i")) for s in "ab"])
    known = steps.select(F.explode(ends).alias("e"), F.date_add("b_ts", 7).alias("from")).where("e.t = 'Supplier'").groupBy(F.col("e.i").alias("department"), "from").agg(F.count(F.lit(1)).alias("n"))
    counted = known.select("department", "n", F.explode(F.sequence(F.col("from"), F.date_add("from", 7 * (RECENT_WEEKS - 1)), F.expr("INTERVAL 7 DAYS"))).alias("week"))
    near = counted.groupBy("department", "week").agg(F.sum("n").alias("n"))
    top = near.groupBy("week").agg(F.max("n").alias("top"))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("top")), F.lit(0.0))
    return weeks.join(near, ["department", "week"], "left").join(top, "week", "left").select("department", "week", share.alias("graph_tpke_edge_density"))


def with_network(lines: DataFrame, steps: DataFrame, rows: DataFrame, laid: Sequence[str]) -> DataFrame:
    """`rows` with the features above: order_date, department, category, city, region, ship_mode, qty and late of `lines` are read.

    `rows` are lines with further columns. Both lie by the columns `laid`, as ranges of time, and stay there: tables that are not small are made per range and come
    to the rows. Tables of entities of the catalogue are written first: their files' size tells the planner that they are small.
    """
    week = F.date_trunc("week", "order_date").cast("date")
    base, out = lines.withColumn("week", week), rows.withColumn("week", week)
    here = base.select("department", "week", *laid).distinct()
    weeks = here.select("department", "week").distinct()
    traded = written(traded_weeks(base, laid), "traded")
    supplier = supplier_breadth(base, traded, weeks).join(inferred_density(steps, weeks), ["department", "week"])
    out = out.join(here.join(supplier, ["department", "week"]).hint("shuffle_hash"), ["department", "week", *laid])
    out = out.join(traded.drop("first").hint("shuffle_hash"), ["department", "category", "week", *laid])
    out = out.join(written(category_totals(base), "totals"), ["category", "week"]).withColumn("graph_supplier_reliability", peer_reliability()).drop("n", "l", "all_n", "all_l")
    for keys, table in (
        (["category"], written(linked_stress(base), "stress")), (["ship_mode", "region"], written(neighbour_routes(base), "routes")), (["region"], written(region_load(base), "load")),
    ):
        out = out.join(table, [*keys, "week"])
    return out.drop("week")
