"""Projections, filters and scalar functions over the order lines."""

from pyspark.sql import functions as F

from freightloom.functions import scalars as S
from freightloom.operators.analytics import r
from freightloom.plans.analytics import week_key
from freightloom.plans.registry import over_items, query
from freightloom.plans.views import CELLS
from freightloom.sources import table

KEY = ["order_id", "line_no", "product_id", "supplier_id", "l_shipdate"]
KEYS = ", ".join(KEY)
BASE = " ".join(KEY) + " "


def rowwise(name, columns, outputs, sql, **views):
    """Register a projection: `outputs` maps a name to a column builder, `sql` lists the same outputs."""
    over_items(
        name, lambda d: d.select(*KEY, *[make(d).alias(n) for n, make in outputs.items()]), BASE + columns,
        f"SELECT {KEYS}, {sql} FROM oi", **views,
    )


rowwise("date_parts", "order_date", {
    "order_year": lambda d: F.year("order_date"), "order_month": lambda d: F.month("order_date"),
    "order_day": lambda d: F.dayofmonth("order_date"), "order_dayofweek": lambda d: F.weekday("order_date"),
    "order_week": lambda d: F.weekofyear("order_date"), "order_quarter": lambda d: F.quarter("order_date"),
    "is_weekend": lambda d: (F.weekday("order_date") >= 5).cast("int"),
}, """year(order_date) AS order_year, month(order_date) AS order_month, day(order_date) AS order_day,
   isodow(order_date) - 1 AS order_dayofweek, weekofyear(order_date) AS order_week, quarter(order_date) AS order_quarter,
   CASE WHEN isodow(order_date) >= 6 THEN 1 ELSE 0 END AS is_weekend""")
rowwise("delivery_duration", "order_date", {
    "delivery_duration_days": lambda d: F.greatest(F.datediff("l_shipdate", "order_date"), F.lit(0)),
}, "greatest(date_diff('day', order_date, l_shipdate), 0) AS delivery_duration_days")
rowwise("period_keys", "order_date", {
    "period_monthly": lambda d: F.date_format("order_date", "yyyy-MM"), "period_weekly": week_key,
    "iso_week_key": lambda d: F.concat(
        F.extract(F.lit("YEAROFWEEK"), "order_date").cast("string"), F.lit("-W"),
        F.lpad(F.weekofyear("order_date").cast("string"), 2, "0")),
}, """strftime(order_date, '%Y-%m') AS period_monthly,
   (year(order_date) || '-W' || lpad(CAST(weekofyear(order_date) AS VARCHAR), 2, '0')) AS period_weekly,
   (isoyear(order_date) || '-W' || lpad(CAST(weekofyear(order_date) AS VARCHAR), 2, '0')) AS iso_week_key""")
rowwise("holiday_flag", "order_date", {
    "is_holiday_period": lambda d: F.month("order_date").isin(10, 11, 12, 1).cast("int"),
    "is_month_end": lambda d: (F.dayofmonth("order_date") >= 25).cast("int"),
}, """CASE WHEN month(order_date) IN (10, 11, 12, 1) THEN 1 ELSE 0 END AS is_holiday_period,
   CASE WHEN day(order_date) >= 25 THEN 1 ELSE 0 END AS is_month_end""")


def _price_mean(d):
    m = d.agg(F.avg("product_price").alias("m"))
    return m.select(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("m")).scalar()


rowwise("ratio_features", "product_price discount sales qty", {
    "price_ratio": lambda d: r(F.coalesce(F.col("product_price") / _price_mean(d), F.lit(1.0))),
    "discount_rate": lambda d: r(F.when(F.col("sales") > 0, F.col("discount") / F.col("sales")).otherwise(0.0)),
    "revenue_per_unit": lambda d: r(F.when(F.col("qty") > 0, F.col("sales") / F.col("qty")).otherwise(0.0), 8),
}, """round(product_price / (SELECT CASE WHEN avg(product_price) > 0 THEN avg(product_price) ELSE 1.0 END FROM oi), 6) AS price_ratio,
   round(CASE WHEN sales > 0 THEN discount / sales ELSE 0.0 END, 6) AS discount_rate,
   round(CASE WHEN qty > 0 THEN sales / qty ELSE 0.0 END, 8) AS revenue_per_unit""")
rowwise("log_features", "sales qty", {
    "sales_log": lambda d: r(F.log1p(F.greatest("sales", F.lit(0.0)))),
    "quantity_log": lambda d: r(F.log1p(F.greatest("qty", F.lit(0.0)))),
}, "round(ln(1 + greatest(sales, 0.0)), 6) AS sales_log, round(ln(1 + greatest(qty, 0.0)), 6) AS quantity_log")


def post_shipment(d):
    """Observed gap, lateness, delay ratio and the composite risk 0.4 / 0.4 / 0.2."""
    delay = F.when(F.col("days_sched") > 0, F.col("days_real") / F.col("days_sched")).otherwise(1.0)
    d = d.withColumn("ratio", delay)
    top = d.agg(F.max("ratio").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("m")).scalar()
    share = F.when(F.col("sales") > 0, F.col("discount") / F.col("sales")).otherwise(0.0)
    late = d.groupBy("department").agg(F.avg("late").alias("dept_rate"))
    d = d.join(late, "department")
    return d.select(
        *KEY, (F.col("days_real") - F.col("days_sched")).alias("delivery_gap"), F.col("late").alias("is_delayed"),
        r(F.col("ratio")).alias("shipping_delay_ratio"),
        r(S.clip(F.col("ratio") / top * 0.4 + F.col("dept_rate") * 0.4 + share * 0.2, 0.0, 1.0), 8).alias("composite_risk_score"),
    )


over_items(
    "post_shipment", post_shipment, BASE + "days_real days_sched late sales discount department",
    f"""SELECT {KEYS}, days_real - days_sched AS delivery_gap, late AS is_delayed, round(days_real / days_sched, 6) AS shipping_delay_ratio,
        round(greatest(least(days_real / days_sched / (SELECT max(days_real / days_sched) FROM oi) * CAST(0.4 AS DOUBLE)
          + avg(late) OVER (PARTITION BY department) * CAST(0.4 AS DOUBLE)
          + CASE WHEN sales > 0 THEN discount / sales ELSE 0.0 END * CAST(0.2 AS DOUBLE), 1.0), 0.0), 8) AS composite_risk_score FROM oi""",
)
rowwise("bin_fixed", "days_real days_sched", {
    # left-closed bins with the bounds -999, -1, 0, 3, 7, 999
    "delay_category": lambda d: F.expr(
        "CASE WHEN days_real - days_sched < -1 THEN 0 WHEN days_real - days_sched < 0 THEN 1 "
        "WHEN days_real - days_sched < 3 THEN 2 WHEN days_real - days_sched < 7 THEN 3 ELSE 4 END"),
}, """CASE WHEN days_real - days_sched < -1 THEN 0 WHEN days_real - days_sched < 0 THEN 1 WHEN days_real - days_sched < 3 THEN 2
   WHEN days_real - days_sched < 7 THEN 3 ELSE 4 END AS delay_category""")


def value_tier(d, bins: int = 4):
    v = F.round(F.log1p(F.greatest("sales", F.lit(0.0))), 9)
    d = d.withColumn("v", v)
    span = d.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    place = F.floor((F.col("v") - span["lo"]) / (span["hi"] - span["lo"]) * bins)
    return F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)), d


def bin_equal_width(d):
    tier, d = value_tier(d)
    return d.select(*KEY, tier.cast("int").alias("order_value_tier"))


over_items(
    "bin_equal_width", bin_equal_width, BASE + "sales",
    f"""SELECT {KEYS}, CAST(least(greatest(floor((v - lo) / (hi - lo) * 4), 0), 3) AS INTEGER) AS order_value_tier
        FROM (SELECT *, round(ln(1 + greatest(sales, 0.0)), 9) AS v FROM oi),
             (SELECT min(round(ln(1 + greatest(sales, 0.0)), 9)) AS lo, max(round(ln(1 + greatest(sales, 0.0)), 9)) AS hi FROM oi)""",
)
rowwise("ordinal_maps", "ship_mode segment", {
    "shipping_priority": lambda d: F.expr(
        "CASE ship_mode WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END"),
    "customer_value_tier": lambda d: F.expr("CASE segment WHEN 'MACHINERY' THEN 3 WHEN 'BUILDING' THEN 2 ELSE 1 END"),
}, """CASE ship_mode WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 ELSE 1 END AS shipping_priority,
   CASE segment WHEN 'MACHINERY' THEN 3 WHEN 'BUILDING' THEN 2 ELSE 1 END AS customer_value_tier""")


def zscore(d, column: str):
    s = d.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return F.when(s["s"] > 0, (F.col(column) - s["m"]) / s["s"]).otherwise(0.0)


rowwise("zscore", "sales qty", {"sales_z": lambda d: r(zscore(d, "sales")), "qty_z": lambda d: r(zscore(d, "qty"))},
        """round((sales - (SELECT avg(sales) FROM oi)) / (SELECT stddev_samp(sales) FROM oi), 6) AS sales_z,
   round((qty - (SELECT avg(qty) FROM oi)) / (SELECT stddev_samp(qty) FROM oi), 6) AS qty_z""")

_LATE_BY = "SELECT department, avg(late) AS p FROM oi GROUP BY department"


def by_department(run, columns="department late"):
    return columns, lambda d: run(d.groupBy("department").agg(F.avg("late").alias("p")))


_cols, _run = by_department(lambda g: g.select("department", r(F.col("p")).alias("score"), S.risk_label(F.col("p") * 2 - 0.4).alias("label")))
over_items("risk_label", _run, _cols,
           """SELECT department, round(p, 6) AS score, CASE WHEN p * 2 - 0.4 >= 0.75 THEN 'critical' WHEN p * 2 - 0.4 >= 0.5 THEN 'high'
              WHEN p * 2 - 0.4 >= 0.25 THEN 'medium' ELSE 'low' END AS label FROM g""", g=_LATE_BY)
_cols, _run = by_department(lambda g: g.select(
    "department", S.risk_label_3("p").alias("label"), S.risk_label_3("p", 0.55, 0.35).alias("label_strict")))
over_items("risk_label_3", _run, _cols,
           """SELECT department, CASE WHEN p >= 0.65 THEN 'high' WHEN p >= 0.35 THEN 'medium' ELSE 'low' END AS label,
              CASE WHEN p >= 0.55 THEN 'high' WHEN p >= 0.35 THEN 'medium' ELSE 'low' END AS label_strict FROM g""", g=_LATE_BY)


def minmax(g):
    s = g.agg(F.struct(F.min("p").alias("lo"), F.max("p").alias("hi"))).scalar()
    scaled = F.when(s["hi"] == s["lo"], 0.5).otherwise(F.try_divide(F.col("p") - s["lo"], s["hi"] - s["lo"]))
    return g.select("department", r(scaled).alias("scaled"))


_cols, _run = by_department(minmax)
over_items("minmax_normalize", _run, _cols,
           """SELECT department, round(CASE WHEN hi = lo THEN 0.5 ELSE (p - lo) / (hi - lo) END, 6) AS scaled
              FROM g, (SELECT min(p) AS lo, max(p) AS hi FROM g)""", g=_LATE_BY)


def first_positive_risk(d):
    """First positive of six risk figures measured per department."""
    delay = F.col("days_real") - F.col("days_sched")
    g = d.groupBy("department").agg(
        F.avg(delay).alias("risk_score"), F.avg("late").alias("late_rate"), F.avg("qty").alias("load"),
        F.sum("profit").alias("profit"),
    )
    return g.select("department", r(S.first_positive(
        F.col("risk_score") - 1.3, F.col("late_rate") - 0.46, F.col("late_rate") - 0.44, -F.col("profit"), F.col("load") - 26, "late_rate",
    )).alias("risk"))


over_items(
    "first_positive_risk", first_positive_risk, "department days_real days_sched late qty profit",
    """SELECT department, round(coalesce(CASE WHEN a > 0 THEN a END, CASE WHEN b > 0 THEN b END, CASE WHEN c > 0 THEN c END,
         CASE WHEN e > 0 THEN e END, CASE WHEN f > 0 THEN f END, CASE WHEN l > 0 THEN l END, 0.0), 6) AS risk
       FROM (SELECT department, avg(days_real - days_sched) - 1.3 AS a, avg(late) - 0.46 AS b, avg(late) - 0.44 AS c,
         -sum(profit) AS e, avg(qty) - 26 AS f, avg(late) AS l FROM oi GROUP BY department)""",
)
_TITLE = """list_aggregate(list_transform(string_split(replace(replace(lower(trim({c})), '_', ' '), '  ', ' '), ' '),
   lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ')"""


def _names(d):
    return d.select(F.concat(F.lit(" "), "city", F.lit("__"), F.lower("segment"), F.lit(" x-y ")).alias("raw")).distinct()


_NAMES_SQL = "SELECT DISTINCT ' ' || city || '__' || lower(segment) || ' x-y ' AS raw FROM oi"
over_items(
    "normalize_entity", lambda d: _names(d).select("raw", S.normalize_entity("raw").alias("name"), S.slugify("raw").alias("slug")),
    "city segment",
    f"""SELECT raw, {_TITLE.format(c='raw')} AS name, replace(replace(lower({_TITLE.format(c='raw')}), ' ', '_'), '-', '_') AS slug FROM n""",
    n=_NAMES_SQL,
)
over_items(
    "node_id_md5", lambda d: d.select("customer_id").distinct().select("customer_id", S.node_id("Customer", "customer_id").alias("node_id")),
    "customer_id",
    "SELECT DISTINCT customer_id, substr(md5('Customer:' || customer_id), 1, 12) AS node_id FROM oi",
)


@query("safe_cast", sql="""
SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN -1.0 ELSE v END AS safe_value
FROM (SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN 'bad' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN NULL
  ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events)""")
def safe_cast(spark, sf_dir):
    k = F.col("event_id") % 5
    text = (
        F.when(k == 0, F.lit("bad")).when(k == 1, F.lit("NaN")).when(k == 2, F.lit("Infinity")).when(k == 3, None)
        .otherwise(F.col("value").cast("string"))
    )
    return table(spark, sf_dir, "events").select("event_id", S.safe_double(text, -1.0).alias("safe_value"))


def filter_multi(d, region=None, category=None, contains=None, start=None, end=None):
    """Optional equality and date filters, and a case-insensitive search in the department."""
    if region is not None:
        d = d.where(F.col("region") == region)
    if category is not None:
        d = d.where(F.col("category") == category)
    if contains is not None:
        d = d.where(F.col("department").ilike(f"%{contains}%"))
    if start is not None:
        d = d.where(F.col("order_date") >= F.lit(start).cast("date"))
    if end is not None:
        d = d.where(F.col("order_date") <= F.lit(end).cast("date"))
    return d


over_items(
    "filter_multi",
    lambda d: filter_multi(d, region=d.agg(F.min("region")).scalar(), contains="SUPPLIER#00000001", start="1996-01-01", end="1999-12-31")
    .select(*KEY, "department", "qty"),
    BASE + "region category department order_date qty",
    f"""SELECT {KEYS}, department, qty FROM oi WHERE region = (SELECT min(region) FROM oi) AND department ILIKE '%SUPPLIER#00000001%'
        AND order_date BETWEEN '1996-01-01' AND '1999-12-31'""",
)


def filter_period(d, period, minimum: int = 10):
    """Rows of one month; all rows when the month has fewer than `minimum`."""
    n = d.where(F.col("period") == period).agg(F.count(F.lit(1)).alias("n")).scalar()
    return d.where((F.col("period") == period) | (n < minimum))


over_items(
    "filter_period", lambda d: filter_period(d, "1998-03").groupBy("period").agg(F.count(F.lit(1)).alias("n")), "period",
    """SELECT period, count(*) AS n FROM oi WHERE period = '1998-03'
       OR (SELECT count(*) FROM oi WHERE period = '1998-03') < 10 GROUP BY period""",
)


def resolve_column(columns, *candidates):
    """First column whose letters contain the letters of a candidate."""
    def letters(text):
        return "".join(ch for ch in text.lower() if "a" <= ch <= "z")

    return next((c for c in columns if any(letters(x) in letters(c) for x in candidates)), None)


def fuzzy_resolve(d):
    d = d.select(F.col("category").alias("Category_Name "), F.col("region").alias("order-region"), F.col("qty").alias("Order Item QTY"))
    c, g, q = (resolve_column(d.columns, *n) for n in (("Category Name", "category"), ("Order Region", "region"), ("quantity", "qty")))
    return d.groupBy(F.col(f"`{c}`").alias("category"), F.col(f"`{g}`").alias("region")).agg(F.sum(f"`{q}`").alias("qty"))


over_items(
    "fuzzy_column_resolve", fuzzy_resolve, "category region qty",
    "SELECT category, region, sum(qty) AS qty FROM oi GROUP BY category, region",
)


def growth(d):
    """Mean of the later half of the months against the earlier half, per region; an odd month goes to the later half."""
    from pyspark.sql import Window

    m = d.groupBy("region", "period").agg(F.sum("qty").alias("v"))
    w = Window.partitionBy("region")
    m = m.withColumn("rn", F.row_number().over(w.orderBy("period"))).withColumn("n", F.count(F.lit(1)).over(w))
    early = F.col("rn") <= F.floor(F.col("n") / 2)
    g = m.groupBy("region").agg(F.avg(F.when(early, F.col("v"))).alias("e"), F.avg(F.when(~early, F.col("v"))).alias("l"))
    return g.select("region", r(F.col("e"), 4).alias("earlier"), r(F.col("l"), 4).alias("later"), r(S.change_pct("l", "e"), 4).alias("growth_pct"))


over_items(
    "change_pct", growth, "region period qty",
    """SELECT region, round(e, 4) AS earlier, round(l, 4) AS later, round(CASE WHEN e = 0 AND l = 0 THEN 0.0 WHEN e = 0 THEN 100.0
         ELSE (l - e) / abs(e) * 100 END, 4) AS growth_pct
       FROM (SELECT region, avg(v) FILTER (rn <= n // 2) AS e, avg(v) FILTER (rn > n // 2) AS l
         FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY period) AS rn, count(*) OVER (PARTITION BY region) AS n
           FROM (SELECT region, period, sum(qty) AS v FROM oi GROUP BY region, period)) GROUP BY region)""",
)
HISTORY = "array<struct<period:string,qty:bigint>>"


def json_history_append(d, keep: int = 10):
    """Monthly demand per region kept as JSON text; the last month is appended and the last ten entries stay.

    The stored list is bounded by `keep`, so collecting it per region is bounded too.
    """
    from pyspark.sql import Window

    m = d.groupBy("region", "period").agg(F.sum("qty").cast("long").alias("qty"))
    back = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("period")))
    m = m.withColumn("b", back).where(F.col("b") <= keep + 1)
    entry = F.struct("period", "qty")
    g = m.groupBy("region").agg(
        F.to_json(F.array_sort(F.collect_list(F.when(F.col("b") > 1, entry)))).alias("stored"),
        F.max(F.when(F.col("b") == 1, entry)).alias("new"),
    )
    entries = F.coalesce(F.from_json("stored", HISTORY), F.array().cast(HISTORY))
    longer = F.concat(entries, F.array("new"))
    kept = F.when(F.size(longer) > keep, F.slice(longer, -keep, keep)).otherwise(longer)
    return g.select("region", F.to_json(kept).alias("history"))


over_items(
    "json_history_append", json_history_append, "region period qty",
    """SELECT region, '[' || string_agg('{"period":"' || period || '","qty":' || q || '}', ',' ORDER BY period) || ']' AS history
       FROM (SELECT region, period, CAST(sum(qty) AS BIGINT) AS q, row_number() OVER (PARTITION BY region ORDER BY period DESC) AS b
             FROM oi GROUP BY region, period) WHERE b <= 10 GROUP BY region""",
)


def flatten_properties(d):
    """One level of a nested struct becomes key_subkey columns, lists become text."""
    g = d.groupBy("city").agg(F.struct(F.sum("late").alias("late"), F.count(F.lit(1)).alias("n")).alias("orders"),
                              F.array_sort(F.collect_set("ship_mode")).alias("modes"))
    flat = []
    for f in g.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            flat += [F.col(f"{f.name}.{s}").alias(f"{f.name}_{s}") for s in f.dataType.names]
        else:
            flat.append(F.array_join(f.name, ", ").alias(f.name) if kind == "array" else F.col(f.name))
    return g.select(*flat)


over_items(
    "flatten_properties", flatten_properties, "city late ship_mode",
    """SELECT city, CAST(sum(late) AS BIGINT) AS orders_late, count(*) AS orders_n,
       string_agg(DISTINCT ship_mode, ', ' ORDER BY ship_mode) AS modes FROM oi GROUP BY city""",
)
rowwise("commerce_flags", "profit sales discount qty product_price", {
    "profit_margin": lambda d: r(S.clip(F.col("profit") / F.when(F.col("sales") == 0, 1.0).otherwise(F.col("sales")), -1.0, 1.0)),
    "discount_flag": lambda d: (F.col("discount") > 0).cast("int"),
    "high_discount": lambda d: (F.col("discount") > 0.2).cast("int"),
    "order_value": lambda d: r(F.col("qty") * F.col("product_price"), 4),
}, """round(greatest(least(profit / CASE WHEN sales = 0 THEN 1.0 ELSE sales END, 1.0), -1.0), 6) AS profit_margin,
   CASE WHEN discount > 0 THEN 1 ELSE 0 END AS discount_flag, CASE WHEN discount > 0.2 THEN 1 ELSE 0 END AS high_discount,
   round(qty * product_price, 4) AS order_value""")
