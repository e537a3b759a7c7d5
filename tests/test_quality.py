import datetime

import pytest
from pyspark.sql import functions as F

from freightloom.operators import quality as Q

D = datetime.date


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [
        (1, 1, 10.0, 2, 3, " First Class ", "Consumer", 5.0, 0.1, D(2020, 1, 5), D(2020, 1, 8)),
        (2, 0, -5.0, -1, 70, "Invalid", "Invalid", 6.0, 0.9, D(2020, 1, 9), D(2020, 1, 5)),
        (3, None, 20.0, 4, 1, "First Class", "Corporate", None, 0.0, D(2020, 1, 30), D(2020, 1, 1)),
        (4, 1, 30.0, 1, 2, None, None, 8.0, -0.2, None, D(2020, 1, 1)),
        (4, 1, 30.0, 1, 2, None, None, 8.0, -0.2, None, D(2020, 1, 1)),
    ]
    return spark.createDataFrame(
        rows, "id int, late int, product_price double, qty int, days_real int, mode string, segment string, sales double, discount double, o date, s date")


def col(df, c):
    return [r[c] for r in df.orderBy("id").collect()]


def test_duplicates(dirty):
    assert Q.duplicate_rows(dirty).first()[:] == (1, 4, 20.0)
    assert Q.drop_duplicates(dirty).count() == 4
    assert Q.dedup_keep_last(dirty, ["id"], ["sales"]).count() == 4


def test_imputation(dirty):
    assert col(Q.impute_median(dirty, ["sales"]), "sales") == [5.0, 6.0, 7.0, 8.0, 8.0]
    assert col(Q.impute_mode(dirty, ["segment"]), "segment") == ["Consumer", "Invalid", "Corporate", "Consumer", "Consumer"]
    empty = dirty.withColumn("x", F.lit(None).cast("string"))
    assert set(col(Q.impute_mode(empty, ["x"]), "x")) == {"Unknown"}


def test_dates_are_swapped_only_within_a_week(dirty):
    got = Q.swap_dates(dirty, "o", "s").orderBy("id").collect()
    assert [r.swapped for r in got] == [0, 1, 0, 0, 0] and got[1].o == D(2020, 1, 5) and got[1].s == D(2020, 1, 9)


def test_values(dirty):
    assert col(Q.abs_negatives(dirty, ["product_price"]), "product_price")[1] == 5.0
    capped = Q.cap_values(dirty)
    assert col(capped, "days_real")[1] == 60 and col(capped, "discount") == [0.1, 0.8, 0.0, 0.0, 0.0]
    modes = col(Q.normalize_categories(dirty, {"mode": (["First Class", "Second Class"], "Second Class")}), "mode")
    assert modes == ["First Class", "Second Class", "First Class", "Second Class", "Second Class"]


def test_rules_and_profile(dirty):
    rules = {r["rule"]: r.violations for r in Q.business_rules(dirty).collect()}
    assert rules == {"negative_price": 1, "non_positive_qty": 1, "negative_days": 0, "non_binary_target": 0, "negative_sales": 0}
    p = {r.column_name: r for r in Q.null_profile(dirty.select("late", "segment")).collect()}
    assert (p["late"].null_count, p["late"].distinct_count, p["segment"].null_pct) == (1, 2, 40.0)
    assert Q.drop_null_target(dirty, ["late"]).count() == 4


def test_contract_is_case_insensitive(dirty):
    got = {r.column_name: (r.present, r.n_values) for r in Q.check_schema(dirty, ["LATE", "Market"], ["Segment"]).collect()}
    assert got == {"LATE": (1, 4), "Market": (0, 0), "Segment": (1, 3)}


def test_unparseable_dates(spark):
    df = spark.createDataFrame([("01/31/2020",), ("bad",), (None,)], "d string")
    r = Q.date_parse_audit(df, "d").first()
    assert (r.unparseable, r.source_nulls, r.first_date) == (1, 1, D(2020, 1, 31))
