"""Validation, cleaning and profiling of wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.operators.ordered import long_form, modes, quantiles

VALID_REGION_DAYS = 60
MAX_DISCOUNT = 0.80
MIN_ROWS = 1000
# Columns that never leave the cleaning step.
PRIVATE_COLUMNS = (
    "customer_email", "customer_password", "customer_street", "product_image", "product_description",
    "customer_fname", "customer_lname", "order_zipcode", "customer_zipcode",
)
# Weights of the quality score.
QUALITY_WEIGHTS = {"completeness": 0.30, "schema": 0.25, "consistency": 0.20, "uniqueness": 0.15, "validity": 0.10}


def rows() -> Column:
    return F.count(F.lit(1))


def check_row_count(df: DataFrame, minimum: int = MIN_ROWS) -> DataFrame:
    return df.agg(rows().alias("n_rows")).select(
        "n_rows", F.when(F.col("n_rows") < minimum, "fail").otherwise("pass").alias("status")
    )


def check_schema(df: DataFrame, required: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """One row per contract column: required or optional, present (case-insensitive) and values found."""
    present = {c.strip().lower(): c for c in df.columns}
    contract = [(c, "required") for c in required] + [(c, "optional") for c in optional]
    found = [present[c.lower()] for c, _ in contract if c.lower() in present]
    counts = df.agg(*[F.count(c).alias(c) for c in found]).unpivot([], found, "name", "n_values")
    spec = df.sparkSession.createDataFrame(
        [(c, k, present.get(c.lower())) for c, k in contract], "column_name string, kind string, name string"
    )
    return spec.join(counts, "name", "left").select(
        "column_name", "kind", F.col("name").isNotNull().cast("int").alias("present"),
        F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count, percentage and distinct values of every column.

    Values are counted per (column, value) first, so that one pass with map-side combine serves all columns.
    """
    values = long_form(df, df.columns, "string").groupBy("column_name", "value").agg(rows().alias("_n"))
    missing = F.sum(F.when(F.col("value").isNull(), F.col("_n")).otherwise(0))
    return values.groupBy("column_name").agg(
        F.sum("_n").alias("n_rows"),
        missing.alias("null_count"),
        F.round(missing / F.sum("_n") * 100, 6).alias("null_pct"),
        F.count("value").alias("distinct_count"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    counts = df.agg(
        rows().alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    ).unpivot(["_rows"], df.columns, "column_name", "missing_count")
    return counts.where("missing_count > 0").select(
        "column_name", "missing_count", F.round(F.col("missing_count") / F.col("_rows") * 100, 6).alias("missing_pct")
    ).orderBy(F.desc("missing_count"), "column_name")


def duplicate_rows(df: DataFrame) -> DataFrame:
    g = df.groupBy(*df.columns).agg(rows().alias("_n"))
    return g.agg(
        F.sum(F.col("_n") - 1).alias("total_duplicates"),
        rows().alias("unique_rows"),
        F.round(F.sum(F.col("_n") - 1) / F.sum("_n") * 100, 6).alias("duplicate_pct"),
    )


def parse_date(column: str, fmt: str = "MM/dd/yyyy") -> Column:
    """Text to date; anything that does not parse becomes null."""
    return F.try_to_timestamp(F.col(column), F.lit(fmt)).cast("date")


def date_parse_audit(df: DataFrame, column: str) -> DataFrame:
    parsed = parse_date(column)
    return df.agg(
        rows().alias("n_rows"),
        F.count_if(F.col(column).isNull()).alias("source_nulls"),
        F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias("unparseable"),
        F.min(parsed).alias("first_date"), F.max(parsed).alias("last_date"),
    )


def temporal_consistency(df: DataFrame, order_date: str, ship_date: str) -> DataFrame:
    bad = F.col(ship_date) < F.col(order_date)
    return df.agg(rows().alias("n_rows"), F.count_if(bad).alias("reversed")).withColumn(
        "reversed_pct", F.round(F.try_divide("reversed", "n_rows") * 100, 6)
    )


def rule_violations() -> dict[str, Column]:
    c = F.col
    return {
        "negative_price": c("product_price") < 0,
        "non_positive_qty": c("qty") <= 0,
        "negative_days": c("days_real") < 0,
        "non_binary_target": c("late").isNotNull() & ~c("late").isin(0, 1),
        "negative_sales": c("sales") < 0,
    }


def business_rules(df: DataFrame) -> DataFrame:
    rules = rule_violations()
    return df.agg(*[F.count_if(cond).alias(n) for n, cond in rules.items()]).unpivot(
        [], list(rules), "rule", "violations"
    )


def quality_score(df: DataFrame, required: Sequence[str], order_date: str, ship_date: str) -> DataFrame:
    """Weighted score of completeness, schema match, consistency, uniqueness and validity."""
    cols = df.columns
    present = {c.lower() for c in cols}
    schema_match = sum(c.lower() in present for c in required) / len(required)
    rules = rule_violations()
    # one pass groups equal rows, all figures follow from the grouped rows weighted by their count
    g = df.groupBy(*cols).agg(rows().alias("_n"))
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    hit = lambda cond: F.max(F.coalesce(cond, F.lit(False)).cast("int"))
    facts = g.agg(
        F.sum("_n").alias("n"), rows().alias("distinct_rows"), F.sum(nulls * F.col("_n")).alias("nulls"),
        hit(F.col(ship_date) < F.col(order_date)).alias("date_issues"),
        sum((hit(cond) for cond in rules.values()), F.lit(0)).alias("rules_hit"),
    )
    w = QUALITY_WEIGHTS
    facts = facts.select(
        (1 - F.col("nulls") / (F.col("n") * len(cols))).alias("completeness"),
        F.lit(float(schema_match)).alias("schema_match"),
        F.greatest(F.lit(0.0), 1 - F.col("date_issues") * 0.1).alias("consistency"),
        (F.col("distinct_rows") / F.col("n")).alias("uniqueness"),
        F.greatest(F.lit(0.0), 1 - F.col("rules_hit") * 0.1).alias("validity"),
    )
    score = (
        w["completeness"] * F.col("completeness") + w["schema"] * F.col("schema_match")
        + w["consistency"] * F.col("consistency") + w["uniqueness"] * F.col("uniqueness")
        + w["validity"] * F.col("validity")
    )
    return facts.select(*[F.round(c, 6).alias(c) for c in facts.columns], F.round(score, 6).alias("quality_score"))


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_keep_last(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key along the order; only one row per key and task reaches the shuffle."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric nulls become the exact median of their column."""
    medians = quantiles(long_form(df, columns), "column_name", "value", [0.5])
    picks = medians.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q0"))).alias(c) for c in columns])
    row = picks.select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), row[c]) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str], unknown: str = "Unknown") -> DataFrame:
    """Text nulls become the most frequent value (smallest on ties), or `unknown` when there is none."""
    found = modes(long_form(df, columns, "string"), "column_name", "value")
    row = found.agg(
        *[F.max(F.when(F.col("column_name") == c, F.col("mode"))).alias(c) for c in columns]
    ).select(F.struct(*columns)).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), row[c], F.lit(unknown)) for c in columns})


def drop_null_target(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def swap_dates(df: DataFrame, order_date: str, ship_date: str, days: int = 7) -> DataFrame:
    """Swap the two dates where they are reversed by at most `days`."""
    o, s = F.col(order_date), F.col(ship_date)
    swap = (s < o) & (F.datediff(o, s) <= days)
    return df.withColumns({
        order_date: F.when(swap, s).otherwise(o), ship_date: F.when(swap, o).otherwise(s),
        "swapped": F.coalesce(swap, F.lit(False)).cast("int"),
    })


def abs_negatives(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.abs(c) for c in columns})


def normalize_categories(df: DataFrame, domains: dict[str, tuple[Sequence[str], str | None]]) -> DataFrame:
    """Trim; values out of the domain become the default, or the column's mode when no default is given."""
    trimmed = df.withColumns({c: F.trim(c) for c in domains})
    by_mode = [c for c, (_, default) in domains.items() if default is None]
    fills = {c: F.lit(default) for c, (_, default) in domains.items() if default is not None}
    if by_mode:
        found = modes(long_form(trimmed, by_mode, "string"), "column_name", "value")
        row = found.agg(
            *[F.max(F.when(F.col("column_name") == c, F.col("mode"))).alias(c) for c in by_mode]
        ).select(F.struct(*by_mode)).scalar()
        fills |= {c: row[c] for c in by_mode}
    return trimmed.withColumns({
        c: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(fills[c]) for c, (allowed, _) in domains.items()
    })


def cap_values(df: DataFrame) -> DataFrame:
    def between(c, low, high):
        return F.greatest(F.least(F.col(c), F.lit(high)), F.lit(low))

    return df.withColumns({
        "late": between("late", 0, 1),
        "days_real": F.least(F.col("days_real"), F.lit(VALID_REGION_DAYS)),
        "discount": between("discount", 0.0, MAX_DISCOUNT),
    })


def drop_private(df: DataFrame, columns: Sequence[str] = PRIVATE_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = long_form(df, columns)
    basic = values.groupBy("column_name").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.stddev_samp("value"), 4).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(values, "column_name", "value", [0.25, 0.5, 0.75]).select(
        "column_name", *[F.round(f"q{i}", 4).alias(f"q{p}") for i, p in enumerate((25, 50, 75))]
    )
    return basic.join(q, "column_name")


def topk_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    counted = long_form(df, columns, "string").where("value IS NOT NULL").groupBy("column_name", "value").agg(
        rows().alias("n")
    )
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def iqr_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1.5 x IQR bounds per column and how many values lie outside."""
    q = quantiles(long_form(df, columns), "column_name", "value", [0.25, 0.75]).where("q1 > q0")
    iqr = F.col("q1") - F.col("q0")
    bounds = q.select(
        "column_name", "n", iqr.alias("iqr"), (F.col("q0") - 1.5 * iqr).alias("lo"), (F.col("q1") + 1.5 * iqr).alias("hi")
    )
    row = bounds.agg(*[
        F.max(F.when(F.col("column_name") == c, F.struct("lo", "hi"))).alias(c) for c in columns
    ]).select(F.struct(*columns)).scalar()
    outside = df.withColumn("_b", row).agg(*[
        F.count_if((F.col(c) < F.col(f"_b.{c}.lo")) | (F.col(c) > F.col(f"_b.{c}.hi"))).alias(c) for c in columns
    ]).unpivot([], list(columns), "column_name", "outlier_count")
    return outside.join(bounds, "column_name").where("outlier_count > 0").select(
        "column_name", "outlier_count", F.round(F.col("outlier_count") / F.col("n") * 100, 6).alias("outlier_pct"),
        F.round("lo", 4).alias("lower_bound"), F.round("hi", 4).alias("upper_bound"), F.round("iqr", 4).alias("iqr"),
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute Pearson correlation of every column pair, all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.abs(F.corr(a, b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.unpivot([], one.columns, "pair", "correlation").select(
        F.substring_index("pair", "|", 1).alias("column_1"), F.substring_index("pair", "|", -1).alias("column_2"),
        "correlation",
    )


def top_correlations(df: DataFrame, columns: Sequence[str], floor: float = 0.5, top: int = 10) -> DataFrame:
    return correlations(df, columns).where(F.col("correlation") > floor).select(
        "column_1", "column_2", F.round("correlation", 4).alias("correlation")
    ).orderBy(F.desc("correlation"), "column_1", "column_2").limit(top)


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    g = df.where(F.col(target).isNotNull()).groupBy(target).agg(rows().alias("n"))
    balance = g.agg((F.min("n") / F.max("n")).alias("b")).scalar()
    return g.withColumn("balance_ratio", F.round(balance, 6))


def dataset_summary(df: DataFrame) -> DataFrame:
    numeric = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    kinds = dict(df.dtypes)
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    g = df.groupBy(*df.columns).agg(rows().alias("_n"))
    return g.agg(
        F.sum("_n").alias("row_count"), F.sum(nulls * F.col("_n")).alias("total_null_cells"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
    ).select(
        "row_count", F.lit(len(kinds)).alias("column_count"),
        F.lit(sum(t in numeric for t in kinds.values())).alias("numeric_columns"),
        F.lit(sum(t == "string" for t in kinds.values())).alias("categorical_columns"),
        F.lit(sum(t.startswith(("date", "timestamp")) for t in kinds.values())).alias("datetime_columns"),
        "total_null_cells",
        F.round(F.col("total_null_cells") / (F.col("row_count") * len(kinds)) * 100, 6).alias("total_null_pct"),
        "duplicate_rows",
    )


def integrity_gate(df: DataFrame, columns: Sequence[str], min_rows: int, min_days: int) -> DataFrame:
    """Row floor, date span and required columns of a feature table in one row."""
    lacking = [c for c in columns if c not in df.columns]
    g = df.agg(rows().alias("n_rows"), F.datediff(F.max("order_date"), F.min("order_date")).alias("span_days"))
    ok = (F.col("n_rows") >= min_rows) & (F.col("span_days") >= min_days) & F.lit(not lacking)
    return g.select(
        "n_rows", "span_days", F.lit(len(lacking)).alias("missing_columns"), ok.cast("int").alias("passed")
    )


def period_continuity(df: DataFrame) -> DataFrame:
    """Each month of the data against the month expected after the one before it."""
    months = df.select(F.trunc("order_date", "MM").alias("month")).distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("month")
    expected = F.add_months(F.lag("month").over(w), 1)
    return months.select(
        F.date_format("month", "yyyy-MM").alias("period"), F.date_format(expected, "yyyy-MM").alias("expected")
    ).withColumn("accepted", F.coalesce(F.col("expected") == F.col("period"), F.lit(True)).cast("int"))


def cleaning_report(df: DataFrame, key: Sequence[str], domains: dict[str, Sequence[str]]) -> DataFrame:
    """How many rows or cells each cleaning action touches."""
    trimmed_out = sum(
        (F.count_if(~F.coalesce(F.trim(c).isin(*allowed), F.lit(False))) for c, allowed in domains.items()), F.lit(0)
    )
    swaps = (F.col("ship_raw") < F.col("order_date")) & (F.datediff("order_date", "ship_raw") <= 7)
    one = df.agg(
        (rows() - F.count("late_n")).alias("target_nulls_dropped"),
        (rows() - F.count("sales_n")).alias("median_imputed"),
        F.count_if(F.col("price_n") < 0).alias("negatives_fixed"),
        F.count_if(swaps).alias("dates_fixed"),
        trimmed_out.alias("categories_normalized"),
        (rows() - F.count_distinct(*key)).alias("duplicates_removed"),
    )
    return one.unpivot([], one.columns, "action", "n")
