"""Data quality queries.

The given tables are clean, so the jobs that need dirt run on order lines with damage derived from the keys; the SQL
side derives the same.
"""

from pyspark.sql import functions as F

from freightloom.operators import quality as Q
from freightloom.operators.ordered import fill_gaps
from freightloom.plans.registry import over_items, over_lines
from freightloom.plans.views import ORDER_BY
from freightloom.sources import TOTAL_ORDER

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KEY = "order_id line_no product_id supplier_id l_shipdate"
KEYS = KEY.replace(" ", ", ")


def dirty(d):
    k = F.col("order_id")
    return d.withColumns({
        "sales_n": F.when(k % 10 == 0, None).otherwise(F.col("sales")),
        "segment_n": F.when(k % 11 == 0, None).when(k % 13 == 0, F.lit("Invalid"))
        .when(k % 7 == 0, F.concat(F.lit("  "), F.col("segment"), F.lit(" "))).otherwise(F.col("segment")),
        "late_n": F.when(k % 17 == 0, None).otherwise(F.col("late")),
        "price_n": F.when(k % 19 == 0, -F.col("product_price")).otherwise(F.col("product_price")),
        "date_text": F.when(k % 23 == 0, F.lit("not a date")).when(k % 29 == 0, None)
        .otherwise(F.date_format("order_date", "MM/dd/yyyy")),
        "ship_raw": F.col("l_shipdate"),
        "date_n": F.when(k % 31 == 0, None).otherwise(F.col("order_date")),
    })


DIRTY_SQL = """
SELECT *, CASE WHEN order_id % 10 = 0 THEN NULL ELSE sales END AS sales_n,
  CASE WHEN order_id % 11 = 0 THEN NULL WHEN order_id % 13 = 0 THEN 'Invalid'
       WHEN order_id % 7 = 0 THEN '  ' || segment || ' ' ELSE segment END AS segment_n,
  CASE WHEN order_id % 17 = 0 THEN NULL ELSE late END AS late_n,
  CASE WHEN order_id % 19 = 0 THEN -product_price ELSE product_price END AS price_n,
  CASE WHEN order_id % 23 = 0 THEN 'not a date' WHEN order_id % 29 = 0 THEN NULL
       ELSE strftime(order_date, '%m/%d/%Y') END AS date_text,
  l_shipdate AS ship_raw, CASE WHEN order_id % 31 = 0 THEN NULL ELSE order_date END AS date_n
FROM oi
"""
ALL = "product_price late order_date segment sales "


def over_dirty(name, run, columns, sql, register=over_items):
    columns = " ".join(dict.fromkeys((ALL + KEY + " " + columns).split()))
    register(name, lambda d: run(dirty(d)), columns, sql, dirty=DIRTY_SQL)


over_items(
    "check_row_count", Q.check_row_count, "order_id",
    "SELECT count(*) AS n_rows, CASE WHEN count(*) < 1000 THEN 'fail' ELSE 'pass' END AS status FROM oi",
)
REQUIRED = ["Order_Id", "Order_Date", "Late", "Sales", "Qty", "Ship_Mode"]
OPTIONAL = ["Segment", "Warranty_Code"]
over_dirty(
    "check_schema",
    lambda d: Q.check_schema(
        d.select("order_id", "order_date", "qty", "ship_mode", F.col("late_n").alias("late"),
                 F.col("sales_n").alias("sales"), F.col("segment_n").alias("segment")), REQUIRED, OPTIONAL),
    "qty ship_mode",
    """SELECT 'Order_Id' AS column_name, 'required' AS kind, 1 AS present, count(order_id) AS n_values FROM dirty
       UNION ALL SELECT 'Order_Date', 'required', 1, count(order_date) FROM dirty
       UNION ALL SELECT 'Late', 'required', 1, count(late_n) FROM dirty
       UNION ALL SELECT 'Sales', 'required', 1, count(sales_n) FROM dirty
       UNION ALL SELECT 'Qty', 'required', 1, count(qty) FROM dirty
       UNION ALL SELECT 'Ship_Mode', 'required', 1, count(ship_mode) FROM dirty
       UNION ALL SELECT 'Segment', 'optional', 1, count(segment_n) FROM dirty
       UNION ALL SELECT 'Warranty_Code', 'optional', 0, 0""",
)
_PROFILED = ["order_id", "qty", "segment_n", "late_n", "date_text"]
over_dirty(
    "null_profile", lambda d: Q.null_profile(d.select(*_PROFILED)), "qty",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) / count(*) * 100, 6) AS null_pct, count(DISTINCT {c}) AS distinct_count FROM dirty"""
        for c in _PROFILED
    ),
)
_MISSING = ["sales_n", "segment_n", "late_n", "date_text", "date_n", "order_id"]
over_dirty(
    "missing_report", lambda d: Q.missing_report(d.select(*_MISSING)), "",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count,
        round((count(*) - count({c})) / count(*) * 100, 6) AS missing_pct FROM dirty""" for c in _MISSING
    ) + ") WHERE missing_count > 0",
)
over_items(
    "duplicate_rows", Q.duplicate_rows, "order_id line_no",
    """SELECT CAST(sum(n - 1) AS BIGINT) AS total_duplicates, count(*) AS unique_rows,
       round(sum(n - 1) / sum(n) * 100, 6) AS duplicate_pct
       FROM (SELECT count(*) AS n FROM oi GROUP BY order_id, line_no)""",
)
over_dirty(
    "date_parse_audit", lambda d: Q.date_parse_audit(d, "date_text"), "",
    """SELECT count(*) AS n_rows, count(*) FILTER (date_text IS NULL) AS source_nulls,
       count(*) FILTER (date_text IS NOT NULL AND try_strptime(date_text, '%m/%d/%Y') IS NULL) AS unparseable,
       min(try_strptime(date_text, '%m/%d/%Y'))::date AS first_date,
       max(try_strptime(date_text, '%m/%d/%Y'))::date AS last_date FROM dirty""",
)
over_items(
    "temporal_consistency", lambda d: Q.temporal_consistency(d, "order_date", "l_shipdate"), "order_date l_shipdate",
    """SELECT count(*) AS n_rows, count(*) FILTER (l_shipdate < order_date) AS reversed,
       round(count(*) FILTER (l_shipdate < order_date) / count(*) * 100, 6) AS reversed_pct FROM oi""",
)


def _damaged(d):
    return d.select(
        "order_id", "line_no", "qty", "days_real", F.col("price_n").alias("product_price"), F.col("late_n").alias("late"),
        F.col("sales_n").alias("sales"), "order_date", "ship_raw",
    )


over_dirty(
    "business_rules", lambda d: Q.business_rules(_damaged(d)), "qty days_real",
    """SELECT 'negative_price' AS rule, count(*) FILTER (price_n < 0) AS violations FROM dirty
       UNION ALL SELECT 'non_positive_qty', count(*) FILTER (qty <= 0) FROM dirty
       UNION ALL SELECT 'negative_days', count(*) FILTER (days_real < 0) FROM dirty
       UNION ALL SELECT 'non_binary_target', count(*) FILTER (late_n NOT IN (0, 1)) FROM dirty
       UNION ALL SELECT 'negative_sales', count(*) FILTER (sales_n < 0) FROM dirty""",
)
over_dirty(
    "quality_score",
    lambda d: Q.quality_score(_damaged(d), ["order_id", "order_date", "late", "sales", "market"], "order_date", "ship_raw"),
    "qty days_real",
    """, g AS (SELECT order_id, line_no, qty, days_real, price_n, late_n, sales_n, order_date, ship_raw, count(*) AS n FROM dirty GROUP BY ALL),
       f AS (SELECT 1 - sum(((late_n IS NULL)::int + (sales_n IS NULL)::int) * n) / (sum(n) * 9) AS completeness,
         CAST(0.8 AS DOUBLE) AS schema_match,
         greatest(0.0, 1 - max(CASE WHEN ship_raw < order_date THEN 1 ELSE 0 END) * CAST(0.1 AS DOUBLE)) AS consistency,
         count(*) / sum(n) AS uniqueness,
         greatest(0.0, 1 - (max(CASE WHEN price_n < 0 THEN 1 ELSE 0 END) + max(CASE WHEN qty <= 0 THEN 1 ELSE 0 END)
           + max(CASE WHEN days_real < 0 THEN 1 ELSE 0 END) + max(CASE WHEN late_n NOT IN (0, 1) THEN 1 ELSE 0 END)
           + max(CASE WHEN sales_n < 0 THEN 1 ELSE 0 END)) * CAST(0.1 AS DOUBLE)) AS validity FROM g)
       SELECT round(completeness, 6) AS completeness, round(schema_match, 6) AS schema_match,
         round(consistency, 6) AS consistency, round(uniqueness, 6) AS uniqueness, round(validity, 6) AS validity,
         round(CAST(0.30 AS DOUBLE) * completeness + CAST(0.25 AS DOUBLE) * schema_match + CAST(0.20 AS DOUBLE) * consistency
           + CAST(0.15 AS DOUBLE) * uniqueness + CAST(0.10 AS DOUBLE) * validity, 6) AS quality_score FROM f""",
)
over_items(
    "drop_duplicates", Q.drop_duplicates, "order_id line_no status",
    "SELECT DISTINCT order_id, line_no, status FROM oi",
)
over_items(
    "dedup_keep_last", lambda d: Q.dedup_keep_last(d, ["order_id", "line_no"], ["l_shipdate", "product_id", "supplier_id"]),
    "order_id line_no l_shipdate product_id supplier_id sales",
    """SELECT order_id, line_no, l_shipdate, product_id, supplier_id, sales FROM oi QUALIFY row_number() OVER (
       PARTITION BY order_id, line_no ORDER BY l_shipdate DESC, product_id DESC, supplier_id DESC) = 1""",
)
over_dirty(
    "impute_median", lambda d: Q.impute_median(d.select(*KEY.split(), "sales_n"), ["sales_n"]).withColumn("sales_n", F.round("sales_n", 4)), "",
    f"""SELECT {KEYS}, round(coalesce(sales_n, (SELECT quantile_cont(sales_n, 0.5) FROM dirty)), 4) AS sales_n FROM dirty""",
    over_lines,
)
over_dirty(
    "impute_mode", lambda d: Q.impute_mode(d.select(*KEY.split(), "segment_n"), ["segment_n"]), "",
    f"""SELECT {KEYS}, coalesce(segment_n, (SELECT segment_n FROM dirty WHERE segment_n IS NOT NULL GROUP BY segment_n
       ORDER BY count(*) DESC, segment_n LIMIT 1), 'Unknown') AS segment_n FROM dirty""",
)
over_dirty(
    "impute_ffill_bfill",
    lambda d: fill_gaps(d.select(*TOTAL_ORDER, "slot", "date_n"), [], TOTAL_ORDER, ["order_date", "slot"], "date_n", "date_filled").drop("slot"), "slot",
    f"""SELECT order_date, {KEYS}, date_n, coalesce(last_value(date_n IGNORE NULLS) OVER (ORDER BY {ORDER_BY}
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(date_n IGNORE NULLS) OVER (ORDER BY {ORDER_BY}
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS date_filled FROM dirty""",
    over_lines,
)
over_dirty(
    "drop_null_target", lambda d: Q.drop_null_target(d.select(*KEY.split(), "late_n"), ["late_n", "order_id"]), "",
    f"SELECT {KEYS}, late_n FROM dirty WHERE late_n IS NOT NULL AND order_id IS NOT NULL",
)
over_dirty(
    "swap_dates", lambda d: Q.swap_dates(d.select("order_id", "line_no", "product_id", "order_date", "ship_raw"), "order_date", "ship_raw"), "",
    """SELECT order_id, line_no, product_id, CASE WHEN sw THEN ship_raw ELSE order_date END AS order_date,
       CASE WHEN sw THEN order_date ELSE ship_raw END AS ship_raw, CASE WHEN sw THEN 1 ELSE 0 END AS swapped
       FROM (SELECT *, ship_raw < order_date AND date_diff('day', ship_raw, order_date) <= 7 AS sw FROM dirty)""",
)
over_dirty(
    "abs_negatives", lambda d: Q.abs_negatives(d.select(*KEY.split(), "price_n", "sales"), ["price_n", "sales"]), "",
    f"SELECT {KEYS}, abs(price_n) AS price_n, abs(sales) AS sales FROM dirty",
)
over_dirty(
    "normalize_categories",
    lambda d: Q.normalize_categories(
        d.select(*KEY.split(), F.col("segment_n").alias("by_default"), F.col("segment_n").alias("by_mode")),
        {"by_default": (SEGMENTS, "BUILDING"), "by_mode": (SEGMENTS, None)},
    ), "",
    f"""SELECT {KEYS}, CASE WHEN trim(segment_n) IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY')
         THEN trim(segment_n) ELSE 'BUILDING' END AS by_default,
       CASE WHEN trim(segment_n) IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY') THEN trim(segment_n)
         ELSE (SELECT trim(segment_n) FROM dirty WHERE segment_n IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS by_mode
       FROM dirty""",
)
over_items(
    "cap_values",
    lambda d: Q.cap_values(d.withColumns({"late": F.col("late") * 3 - 1, "days_real": F.col("days_real") * 12,
                                          "discount": F.col("discount") / F.col("sales") * 10})),
    KEY + " late days_real discount sales",
    f"""SELECT {KEYS}, greatest(least(late * 3 - 1, 1), 0) AS late, least(days_real * 12, 60) AS days_real,
        greatest(least(discount / sales * 10, 0.8), 0.0) AS discount, sales FROM oi""",
)
over_items(
    "drop_columns_pii",
    lambda d: Q.drop_private(d.withColumns({"customer_email": F.concat(F.col("customer_id").cast("string"), F.lit("@x")),
                                            "customer_zipcode": F.col("customer_id")})),
    "order_id line_no customer_id status product_id",
    "SELECT order_id, line_no, customer_id, status, product_id FROM oi",
)
over_dirty(
    "cleaning_report", lambda d: Q.cleaning_report(d, ["order_id", "line_no"], {"segment_n": SEGMENTS}), "",
    """SELECT 'target_nulls_dropped' AS action, count(*) - count(late_n) AS n FROM dirty
       UNION ALL SELECT 'median_imputed', count(*) - count(sales_n) FROM dirty
       UNION ALL SELECT 'negatives_fixed', count(*) FILTER (price_n < 0) FROM dirty
       UNION ALL SELECT 'dates_fixed', count(*) FILTER (ship_raw < order_date AND date_diff('day', ship_raw, order_date) <= 7) FROM dirty
       UNION ALL SELECT 'categories_normalized', count(*) FILTER (NOT coalesce(trim(segment_n) IN
         ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'), false)) FROM dirty
       UNION ALL SELECT 'duplicates_removed', count(*) - count(DISTINCT (order_id, line_no)) FROM dirty""",
)
_NUM = ["qty", "sales", "discount", "profit", "days_real"]
over_lines(
    "numeric_profile", lambda d: Q.numeric_profile(d, _NUM), " ".join(_NUM),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25,
        round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75 FROM oi""" for c in _NUM
    ),
)
_TXT = ["status", "city", "segment", "ship_mode"]
over_items(
    "topk_values", lambda d: Q.topk_values(d, _TXT), " ".join(_TXT),
    "SELECT column_name, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM oi GROUP BY {c}" for c in _TXT)
    + ")) WHERE rank <= 5",
)
over_lines(
    "iqr_outliers", lambda d: Q.iqr_outliers(d, _NUM), " ".join(_NUM),
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
        round(count(*) FILTER ({c} < lo OR {c} > hi) / count(*) * 100, 6) AS outlier_pct, round(any_value(lo), 4) AS lower_bound,
        round(any_value(hi), 4) AS upper_bound, round(any_value(q3 - q1), 4) AS iqr
        FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM oi,
              (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3 FROM oi))
        WHERE q3 > q1""" for c in _NUM
    ) + ") WHERE outlier_count > 0",
)
_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1:]]
over_items(
    "top_correlations", lambda d: Q.top_correlations(d, _NUM), " ".join(_NUM),
    "SELECT column_1, column_2, round(c, 4) AS correlation FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, abs(corr({a}, {b})) AS c FROM oi" for a, b in _PAIRS
    ) + ") WHERE c > 0.5 ORDER BY correlation DESC LIMIT 10",
)
over_items(
    "target_distribution", lambda d: Q.target_distribution(d, "late"), "late",
    """, g AS (SELECT late, count(*) AS n FROM oi GROUP BY late)
       SELECT late, n, round((SELECT min(n) / max(n) FROM g), 6) AS balance_ratio FROM g""",
)
over_dirty(
    "dataset_summary", lambda d: Q.dataset_summary(d.select("order_id", "line_no", "status", "date_n", "sales_n")), "status",
    """, g AS (SELECT order_id, line_no, status, date_n, sales_n, count(*) AS n FROM dirty GROUP BY ALL)
       SELECT CAST(sum(n) AS BIGINT) AS row_count, 5 AS column_count, 3 AS numeric_columns, 1 AS categorical_columns,
       1 AS datetime_columns, CAST(sum(((date_n IS NULL)::int + (sales_n IS NULL)::int) * n) AS BIGINT) AS total_null_cells,
       round(sum(((date_n IS NULL)::int + (sales_n IS NULL)::int) * n) / (sum(n) * 5) * 100, 6) AS total_null_pct,
       CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM g""",
)
over_items(
    "integrity_gate", lambda d: Q.integrity_gate(d, ["order_date", "late", "qty"], 1000, 365), "order_date late qty",
    """SELECT count(*) AS n_rows, date_diff('day', min(order_date), max(order_date)) AS span_days, 0 AS missing_columns,
       CASE WHEN count(*) >= 1000 AND date_diff('day', min(order_date), max(order_date)) >= 365 THEN 1 ELSE 0 END AS passed FROM oi""",
)
over_items(
    "period_continuity", Q.period_continuity, "order_date",
    """SELECT strftime(m, '%Y-%m') AS period, strftime(e, '%Y-%m') AS expected,
       CASE WHEN e IS NULL OR e = m THEN 1 ELSE 0 END AS accepted
       FROM (SELECT m, CAST(lag(m) OVER (ORDER BY m) + INTERVAL 1 MONTH AS DATE) AS e
             FROM (SELECT DISTINCT date_trunc('month', order_date)::date AS m FROM oi))""",
)
