"""Window features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.functions.scalars import change_pct
from freightloom.operators import features as X
from freightloom.operators.analytics import r
from freightloom.operators.ordered import bottom_k, with_position
from freightloom.plans.registry import over_items, over_lines
from freightloom.plans.views import ORDER_BY, since, since_sql
from freightloom.sources import TOTAL_ORDER

KEY = ["order_id", "line_no", "product_id", "supplier_id", "l_shipdate"]
KEYS = ", ".join(KEY)
BASE = " ".join(TOTAL_ORDER) + " slot "
CELL = "PARTITION BY category, region"


def prior_sql(value: str) -> str:
    return f"coalesce(avg({value}) OVER (ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5)"


def rate_sql(value: str, keys: str, minimum: int) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({value}) {w} >= {minimum} THEN avg({value}) {w} ELSE {prior_sql(value)} END"


def frame_sql(fn: str, low: int, high: int = 1) -> str:
    end = "CURRENT ROW" if high == 0 else f"{high} PRECEDING"
    return f"{fn} OVER ({CELL} ORDER BY {ORDER_BY} ROWS BETWEEN {low} PRECEDING AND {end})"


def std_sql(n: int) -> str:
    return f"CASE WHEN {frame_sql('count(qty)', n)} >= 2 THEN {frame_sql('stddev_samp(qty)', n)} ELSE 0.0 END"


def lag_sql(n: int) -> str:
    return f"lag(qty, {n}) OVER ({CELL} ORDER BY {ORDER_BY})"


FRAMES = f"""
SELECT *, {frame_sql('avg(qty)', 7)} AS m7, {frame_sql('avg(qty)', 30)} AS m30, {std_sql(14)} AS s14, {std_sql(30)} AS s30,
  {lag_sql(1)} AS prev, {frame_sql('avg(qty)', 13, 0)} AS m14 FROM oi
"""
SAFE30 = "CASE WHEN m30 IS NULL OR m30 = 0 THEN 1.0 ELSE m30 END"
SAFE14 = "CASE WHEN m14 IS NULL OR m14 = 0 THEN 1.0 ELSE m14 END"


def rounded(d, *columns, digits=6):
    return d.select(*KEY, *[r(F.col(c), digits).alias(c) for c in columns])


def feature(name, run, columns, outputs, sql_outputs, source="oi", digits=6, **views):
    """Register a per-row feature query; `sql_outputs` lists the SQL of the outputs in the same order."""
    listed = ", ".join(f"round({s}, {digits}) AS {o}" for o, s in zip(outputs, sql_outputs, strict=True))
    over_lines(
        name, lambda d: rounded(run(d), *outputs, digits=digits), " ".join(dict.fromkeys((BASE + columns).split())),
        f"SELECT {KEYS}, {listed} FROM {source}", **views,
    )


feature(
    "expanding_target_rate", lambda d: X.expanding_target_rate(d, ["department", "ship_mode"]),
    "department ship_mode late", ["rate"], [rate_sql("late", "department, ship_mode", 30)],
)
_W = f"OVER (PARTITION BY department, ship_mode ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND"
feature(
    "expanding_target_rate_compat", lambda d: X.expanding_target_rate(d, ["department", "ship_mode"], compat=True),
    "department ship_mode late", ["rate"],
    [f"CASE WHEN count(late) {_W} 1 PRECEDING) >= 30 THEN avg(late) {_W} 1 PRECEDING) ELSE avg(late) {_W} CURRENT ROW) END"],
)
feature(
    "expanding_group_mean", lambda d: X.expanding_means(d, "qty", {"mean_before": X.CELL}, 10),
    "category region qty", ["mean_before"], [rate_sql("qty", "category, region", 10)],
)
feature(
    "rolling_mean_7", X.demand_frames, "category region qty", ["qty_roll_7", "qty_roll_30"],
    [frame_sql("avg(qty)", 7), frame_sql("avg(qty)", 30)],
)
feature(
    "lag_1_7_30", X.lag_features, "category region qty", ["qty_lag_1", "qty_lag_7", "qty_lag_30"],
    [f"coalesce({lag_sql(n)}, avg(qty) OVER ({CELL}))" for n in (1, 7, 30)],
)
feature(
    "rolling_std_30", X.demand_frames, "category region qty", ["qty_std_30", "qty_std_14"], [std_sql(30), std_sql(14)],
)
feature(
    "demand_volatility", lambda d: X.demand_signals(X.demand_frames(d)), "category region qty", ["demand_volatility"],
    [f"greatest(least(s30 / {SAFE30}, 5.0), 0.0)"], "frames", frames=FRAMES,
)
feature(
    "demand_trend", lambda d: X.demand_signals(X.demand_frames(d)), "category region qty",
    ["demand_trend", "demand_momentum"],
    [f"CASE WHEN m7 IS NULL THEN 0.0 ELSE greatest(least((m7 - m30) / {SAFE30}, 3.0), -2.0) END",
     f"CASE WHEN m7 IS NULL THEN 1.0 ELSE greatest(least(m7 / {SAFE30}, 3.0), 0.0) END"],
    "frames", frames=FRAMES,
)
over_lines(
    "demand_spike_flag", lambda d: X.demand_signals(X.demand_frames(d)).select(*KEY, "demand_spike_flag"),
    BASE + "category region qty",
    f"SELECT {KEYS}, CASE WHEN prev > m7 + 2 * s14 THEN 1 ELSE 0 END AS demand_spike_flag FROM frames", frames=FRAMES,
)
feature(
    "category_demand_rank", X.category_demand_rank, "category qty", ["category_demand_rank"],
    ["greatest(least(em / (SELECT greatest(max(em), 1.0) FROM ranked), 1.0), 0.0)"], "ranked",
    ranked=f"SELECT *, {rate_sql('qty', 'category', 1)} AS em FROM oi",
)
feature(
    "inventory_signals", lambda d: X.inventory_signals(X.demand_frames(d)), "category region qty",
    ["inventory_stress_index", "days_until_reorder", "reorder_point", "stock_coverage_ratio"],
    [f"greatest(least(qty / {SAFE14}, 3.0), 0.0)",
     f"CASE WHEN m7 IS NULL THEN 14.0 ELSE greatest(least(14 - 7 * (m7 / {SAFE30}), 21.0), 0.0) END",
     "coalesce(m7 * 1.5, 0.0)",
     f"CASE WHEN m30 IS NULL THEN 1.0 ELSE greatest(least(m30 / {SAFE14}, 10.0), 0.1) END"],
    "frames", frames=FRAMES,
)
_SR = {"h": rate_sql("late", "department, ship_mode", 30), "dr": rate_sql("late", "department", 30)}
feature(
    "supplier_rates", X.supplier_rates, "department ship_mode late",
    ["supplier_hist_late_rate", "supplier_delay_rate", "supplier_reliability_score", "supplier_risk_index"],
    ["h", "dr", "1 - h", "greatest(least(dr * 0.6 + (1 - (1 - h)) * 0.4, 1.0), 0.0)"], "rates", digits=8,
    rates=f"SELECT *, {_SR['h']} AS h, {_SR['dr']} AS dr FROM oi",
)
feature(
    "route_rates", X.route_rates, "ship_mode region late",
    ["route_hist_late_rate", "region_hist_late_rate", "shipmode_hist_late_rate"],
    [rate_sql("late", k, 30) for k in ("ship_mode, region", "region", "ship_mode")],
)
feature(
    "frequency_encode", lambda d: X.frequency_encode(d, ["ship_mode", "region"]), "ship_mode region",
    ["frequency_full", "frequency_as_of"],
    ["count(*) OVER (PARTITION BY ship_mode, region) / (SELECT max(n) FROM (SELECT count(*) AS n FROM oi GROUP BY ship_mode, region))",
     f"""coalesce(count(*) OVER (PARTITION BY ship_mode, region ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         / nullif(count(*) OVER (ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.0)"""],
)
over_items(
    "diversity_encode",
    lambda d: X.diversity_encode(d, "department", "category").withColumn("diversity", r(F.col("diversity"))),
    "department category",
    """, g AS (SELECT department, count(DISTINCT category) AS n_distinct FROM oi GROUP BY department)
       SELECT department, n_distinct, round(n_distinct / (SELECT max(n_distinct) FROM g), 6) AS diversity FROM g""",
)
feature(
    "graph_context_tier1", X.graph_context_tier1, "category region department ship_mode qty late",
    ["graph_inventory_stress", "graph_avg_shipping_delay", "graph_supplier_reliability", "graph_edge_density"],
    [rate_sql("isi", "category, region", 10), rate_sql("late", "ship_mode, region", 10),
     f"1 - {rate_sql('late', 'department, ship_mode', 30)}",
     f"""coalesce(count(*) OVER (PARTITION BY department, ship_mode ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         / nullif(count(*) OVER (ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0.0)"""],
    "stressed",
    frames=FRAMES, stressed=f"SELECT *, greatest(least(qty / {SAFE14}, 3.0), 0.0) AS isi FROM frames",
)
feature(
    "anchored_features",
    lambda d: X.anchored_features(d.where(F.col("order_date") < since(d, 3)), d.where(F.col("order_date") >= since(d, 3))),
    "category region qty", ["qty_roll_7", "qty_roll_30", "demand_volatility"],
    ["m7", "m30", f"greatest(least(s30 / {SAFE30}, 5.0), 0.0)"], f"frames WHERE order_date >= {since_sql(3)}", frames=FRAMES,
)


def _top_per_group(d):
    g = d.groupBy("category", "city").agg(F.count(F.lit(1)).alias("freq"))
    w = Window.partitionBy("category").orderBy(F.desc("freq"), "city")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


over_items(
    "rank_topn_per_group", _top_per_group, "category city",
    """SELECT category, city, freq, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
         PARTITION BY category ORDER BY freq DESC, city) AS rank
       FROM (SELECT category, city, count(*) AS freq FROM oi GROUP BY category, city)) WHERE rank <= 3""",
)


def seeded_sample(d, size: int = 5000, seed: int = 42):
    """The same number of rows from each month, picked by a seeded digest of their key."""
    months = d.agg(F.count_distinct("period").alias("m")).scalar()
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in KEY], F.lit(str(seed))).cast("binary"))
    return bottom_k(d, ["period"], F.greatest(F.lit(1), F.floor(F.lit(size) / months)), digest)


over_items(
    "stratified_sample", seeded_sample, " ".join(KEY) + " period",
    f"""SELECT {KEYS}, period FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY
          md5(order_id || '|' || line_no || '|' || product_id || '|' || supplier_id || '|' || l_shipdate || '|42')) AS rn FROM oi)
        WHERE rn <= greatest(1, 5000 // (SELECT count(DISTINCT period) FROM oi))""",
)


def first_last(d):
    """Mean quantity of the first 7 and the last 7 and 30 rows per category."""
    def ends(order, n):
        w = Window.partitionBy("category").orderBy(*order)
        return d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)

    latest = ends([F.desc(c) for c in TOTAL_ORDER], 30).groupBy("category").agg(
        r(F.avg(F.when(F.col("_rn") <= 7, F.col("qty")))).alias("last_7"), r(F.avg("qty")).alias("last_30")
    )
    first = ends(TOTAL_ORDER, 7).groupBy("category").agg(r(F.avg("qty")).alias("first_7"))
    return latest.join(first, "category")


over_lines(
    "first_last_n", first_last, BASE + "category qty",
    f"""SELECT category, round(avg(qty) FILTER (b <= 7), 6) AS last_7, round(avg(qty) FILTER (b <= 30), 6) AS last_30,
        round(avg(qty) FILTER (a <= 7), 6) AS first_7
        FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {ORDER_BY}) AS a,
          row_number() OVER (PARTITION BY category ORDER BY {", ".join(c + " DESC" for c in TOTAL_ORDER)}) AS b FROM oi)
        GROUP BY category""",
)


def _monthly(d, *keys):
    return d.groupBy(*keys, "period").agg(F.sum("qty").alias("v"))


def trend_label(d):
    m = _monthly(d, "category")
    back = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("period")))
    g = m.withColumn("b", back).groupBy("category").agg(
        F.avg(F.when(F.col("b") <= 3, F.col("v"))).alias("recent"), F.avg("v").alias("overall")
    )
    diff = (F.col("recent") - F.col("overall")) / F.greatest(F.abs("overall"), F.lit(0.001))
    label = F.when(diff > 0.05, "increasing").when(diff < -0.05, "decreasing").otherwise("stable")
    return g.select("category", r(F.col("recent")).alias("recent"), r(F.col("overall")).alias("overall"), label.alias("trend"))


over_items(
    "trend_label", trend_label, "category period qty",
    """SELECT category, round(rec, 6) AS recent, round(al, 6) AS overall,
       CASE WHEN (rec - al) / greatest(abs(al), 0.001) > 0.05 THEN 'increasing'
            WHEN (rec - al) / greatest(abs(al), 0.001) < -0.05 THEN 'decreasing' ELSE 'stable' END AS trend
       FROM (SELECT category, avg(v) FILTER (b <= 3) AS rec, avg(v) AS al
         FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY period DESC) AS b
           FROM (SELECT category, period, sum(qty) AS v FROM oi GROUP BY category, period)) GROUP BY category)""",
)


def trend_by_granularity(d):
    """Daily demand: the last 7, the last 28 and all points; later half against earlier half."""
    days = d.groupBy("order_date").agg(F.sum("qty").alias("v"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("order_date"))
    spans = F.explode(F.array(*[
        F.struct(F.lit(g).alias("granularity"), F.lit(n).alias("points")) for g, n in (("daily", 7), ("weekly", 28), ("monthly", 1 << 30))
    ]))
    rows = days.withColumn("b", F.row_number().over(w)).select("*", spans.alias("g")).select("*", "g.*").where("b <= points")
    half = F.ntile(2).over(Window.partitionBy("granularity").orderBy(F.desc("b")))
    g = rows.withColumn("half", half).groupBy("granularity").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("e"),
        F.avg(F.when(F.col("half") == 2, F.col("v"))).alias("l"), r(F.avg("v"), 4).alias("average"),
    )
    return g.select(
        "granularity", "n", "average", r(F.col("e"), 4).alias("earlier"), r(F.col("l"), 4).alias("later"),
        r(change_pct("l", "e"), 4).alias("change_pct"),
    )


over_items(
    "trend_by_granularity", trend_by_granularity, "order_date qty",
    """, days AS (SELECT order_date, sum(qty) AS v, row_number() OVER (ORDER BY order_date DESC) AS b FROM oi GROUP BY order_date),
       s AS (SELECT granularity, v, ntile(2) OVER (PARTITION BY granularity ORDER BY b DESC) AS half
         FROM days JOIN (VALUES ('daily', 7), ('weekly', 28), ('monthly', 1073741824)) AS t(granularity, points) ON b <= points),
       g AS (SELECT granularity, count(*) AS n, avg(v) AS a, avg(v) FILTER (half = 1) AS e, avg(v) FILTER (half = 2) AS l FROM s GROUP BY granularity)
       SELECT granularity, n, round(a, 4) AS average, round(e, 4) AS earlier, round(l, 4) AS later,
         round((l - e) / abs(e) * 100, 4) AS change_pct FROM g""",
)


def period_over_period(d):
    m = _monthly(d, "region")
    prev = F.lag("v").over(Window.partitionBy("region").orderBy("period"))
    m = m.withColumn("previous", prev)
    pct = change_pct("v", "previous")
    direction = F.when(F.col("v") > F.col("previous"), "up").when(F.col("v") < F.col("previous"), "down").otherwise("flat")
    return m.where("previous IS NOT NULL").select(
        "region", "period", F.col("v").alias("current"), "previous", (F.col("v") - F.col("previous")).alias("change"),
        r(pct, 4).alias("change_pct"), direction.alias("direction"),
    )


over_items(
    "period_over_period", period_over_period, "region period qty",
    """SELECT region, period, v AS current, p AS previous, v - p AS change, round((v - p) / abs(p) * 100, 4) AS change_pct,
       CASE WHEN v > p THEN 'up' WHEN v < p THEN 'down' ELSE 'flat' END AS direction
       FROM (SELECT *, lag(v) OVER (PARTITION BY region ORDER BY period) AS p
             FROM (SELECT region, period, sum(qty) AS v FROM oi GROUP BY region, period)) WHERE p IS NOT NULL""",
)


def split_dates(d):
    """60/20/20 boundaries of the rows by date, found on daily counts."""
    days = d.groupBy("order_date").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("order_date"))
    total = days.agg(F.sum("n")).scalar()
    c = days.withColumn("upto", upto).withColumn("total", total)

    def at(k):
        return F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("order_date")))

    a, b = F.floor(F.col("total") * 0.6), F.floor(F.col("total") * 0.8)
    return c.agg(
        F.min("order_date").alias("train_start"), at(a).alias("train_end"), F.max(a).alias("train_rows"),
        at(a + 1).alias("val_start"), at(b).alias("val_end"), F.max(b - a).alias("val_rows"),
        at(b + 1).alias("test_start"), F.max("order_date").alias("test_end"), F.max(F.col("total") - b).alias("test_rows"),
    )


over_items(
    "split_dates", split_dates, "order_date",
    """, s AS (SELECT order_date, row_number() OVER (ORDER BY order_date) - 1 AS i, count(*) OVER () AS n FROM oi)
       SELECT min(order_date) AS train_start, max(order_date) FILTER (i = floor(n * 0.6)) AS train_end,
         CAST(max(floor(n * 0.6)) AS BIGINT) AS train_rows, max(order_date) FILTER (i = floor(n * 0.6) + 1) AS val_start,
         max(order_date) FILTER (i = floor(n * 0.8)) AS val_end, CAST(max(floor(n * 0.8) - floor(n * 0.6)) AS BIGINT) AS val_rows,
         max(order_date) FILTER (i = floor(n * 0.8) + 1) AS test_start, max(order_date) AS test_end,
         CAST(max(n - floor(n * 0.8)) AS BIGINT) AS test_rows FROM s""",
)


def chronological_split(d, share: float = 0.8):
    """First 80 % of the rows by time are training rows."""
    total = d.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.floor(total * F.lit(share))
    return with_position(d, [], TOTAL_ORDER, X.SEGMENT).withColumn(
        "part", F.when(F.col("pos") < cut, "train").otherwise("test")
    )


over_lines(
    "chronological_split", lambda d: chronological_split(d).select(*KEY, "pos", "part"), BASE,
    f"""SELECT {KEYS}, i AS pos, CASE WHEN i < floor(n * 0.8) THEN 'train' ELSE 'test' END AS part
        FROM (SELECT *, row_number() OVER (ORDER BY {ORDER_BY}) - 1 AS i, count(*) OVER () AS n FROM oi)""",
)
over_items(
    "sort_temporal", lambda d: d.orderBy(*TOTAL_ORDER), " ".join(TOTAL_ORDER) + " qty",
    f"SELECT {ORDER_BY}, qty FROM oi ORDER BY {ORDER_BY}",
)
over_items(
    "paginate",
    lambda d: d.where(F.col("status") == "RF").select("order_id", "line_no", "product_id", "supplier_id", "l_shipdate", "qty")
    .orderBy("order_id", "line_no", "product_id", "supplier_id", "l_shipdate").offset(200).limit(100),
    "order_id line_no product_id supplier_id l_shipdate qty status",
    """SELECT order_id, line_no, product_id, supplier_id, l_shipdate, qty FROM oi WHERE status = 'RF'
       ORDER BY order_id, line_no, product_id, supplier_id, l_shipdate LIMIT 100 OFFSET 200""",
)
