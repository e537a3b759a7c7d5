import datetime

from pyspark.sql import functions as F

from freightloom.operators import features as X
from tests.conftest import LINE_SCHEMA

OUT = ["qty_roll_7", "qty_roll_30", "demand_volatility", "demand_spike_flag", "inventory_stress_index", "rate"]


def features(df):
    d = X.inventory_signals(X.demand_signals(X.demand_frames(df)))
    return X.expanding_means(d, "late", {"rate": ["department", "ship_mode"]}, 5, base=df)


def table(df):
    return {r["line_no"]: tuple(r[c] for c in OUT) for r in df.select("line_no", *OUT).collect()}


def five(spark, targets=(1, 0, 1, 1, 0)):
    d = datetime.date(2000, 1, 1)
    rows = [(d, i, i, 1, 1, d, 0, "A", "R", "D", "m", 1.0, t) for i, t in enumerate(targets)]
    return spark.createDataFrame(rows, LINE_SCHEMA)


def test_expanding_rate_by_hand(spark):
    d = X.expanding_means(five(spark), "late", {"rate": ["department"]}, 1)
    assert [round(r.rate, 3) for r in d.orderBy("line_no").collect()] == [0.5, 1.0, 0.5, 0.667, 0.75]


def test_compat_variant_sees_the_row_itself(spark):
    d = X.expanding_means(five(spark), "late", {"rate": ["department"]}, 30, compat=True)
    assert [round(r.rate, 3) for r in d.orderBy("line_no").collect()] == [1.0, 0.5, 0.667, 0.75, 0.6]


def test_row_order_of_the_input_does_not_matter(lines):
    assert table(features(lines)) == table(features(lines.orderBy(F.rand(3))))


def test_later_rows_do_not_change_earlier_ones(lines):
    cut = datetime.date(2000, 1, 20)
    whole = table(features(lines).where(F.col("order_date") < F.lit(cut)))
    assert whole == table(features(lines.where(F.col("order_date") < F.lit(cut))))


def test_own_target_is_not_seen(lines):
    flipped = lines.withColumn("late", F.when(F.col("line_no") == 7, 1 - F.col("late")).otherwise(F.col("late")))
    assert table(features(lines))[7] == table(features(flipped))[7]


def test_anchored_features_equal_those_of_the_whole(lines):
    cut = datetime.date(2000, 1, 30)
    old, new = lines.where(F.col("order_date") < F.lit(cut)), lines.where(F.col("order_date") >= F.lit(cut))
    pick = lambda d: {r["line_no"]: (r["qty_roll_7"], r["demand_volatility"]) for r in d.collect()}
    whole = pick(X.demand_signals(X.demand_frames(lines)).where(F.col("order_date") >= F.lit(cut)))
    assert pick(X.anchored_features(old, new)) == whole and whole


def test_network_columns_of_suppliers_by_hand(spark, lines):
    from freightloom.operators import network_features as N

    steps = spark.createDataFrame([], "a_entity_type string, a_entity_id string, b_entity_type string, b_entity_id string, b_ts date")
    for slots in (1, 7):
        d = lines.withColumns({"city": F.col("region"), "slot": F.floor(F.datediff("order_date", F.lit("2000-01-01").cast("date")) * slots / 61).cast("int")})
        got = {r.line_no: r for r in N.with_network(d, steps, d, ["slot"]).collect()}
        rows = d.withColumn("week", F.date_trunc("week", "order_date").cast("date")).collect()
        assert len(got) == len(rows)
        for r in rows[:80]:
            before = [x for x in rows if x.week < r.week]
            others = [x.late for x in before if x.category == r.category and x.department != r.department]
            want = 1 - sum(others) / len(others) if others else 0.5
            known = {x.category for x in before}
            own = {x.category for x in before if x.department == r.department}
            assert abs(got[r.line_no].graph_supplier_reliability - want) < 1e-9
            assert abs(got[r.line_no].supplier_category_diversity - (len(own) / len(known) if known else 0.0)) < 1e-9
