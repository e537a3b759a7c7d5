"""Skew-safe windows against brute force on data where one key and one day hold half of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freightloom.operators.ordered import _between, bottom_k, fill_gaps, in_ranges, modes, quantiles, ranked, rolling, running, running_before, with_position
from freightloom.session import written
from freightloom.sources import TOTAL_ORDER

KEYS, SEGMENT = ["category", "region"], ["order_date", "slot"]


@pytest.fixture(scope="module")
def pdf(lines):
    return lines.toPandas().sort_values(TOTAL_ORDER).reset_index(drop=True)


def by_line(df):
    return df.toPandas().set_index("line_no").sort_index()


def test_running_before(lines, pdf):
    got = by_line(running_before(lines, KEYS, TOTAL_ORDER, SEGMENT, {"s": F.col("qty"), "n": F.lit(1).cast("long")}))
    g = pdf.groupby(KEYS)["qty"]
    want = pd.DataFrame({"line_no": pdf.line_no, "s": g.cumsum() - pdf.qty, "n": g.cumcount()}).set_index("line_no").sort_index()
    assert np.allclose(got.s, want.s) and (got.n == want.n).all()


def test_global_position_with_finer_segments(lines, pdf):
    cut = lines.withColumn("slot", F.floor(F.col("order_id") / 50))
    got = by_line(with_position(cut, [], TOTAL_ORDER, SEGMENT))
    want = pd.Series(range(len(pdf)), index=pdf.line_no).sort_index()
    assert (got.pos == want).all()


@pytest.mark.parametrize("chunk", [31, 64, 65536])
def test_rolling_is_the_same_for_any_chunk_size(lines, pdf, chunk):
    got = by_line(rolling(lines, KEYS, TOTAL_ORDER, SEGMENT, 30, {
        "m7": lambda s: F.avg("qty").over(s.rowsBetween(-7, -1)), "m30": lambda s: F.avg("qty").over(s.rowsBetween(-30, -1)),
        "lag30": lambda s: F.lag("qty", 30).over(s)}, chunk_rows=chunk))
    g = pdf.groupby(KEYS)["qty"]
    want = pd.DataFrame({
        "line_no": pdf.line_no, "m7": g.transform(lambda x: x.shift(1).rolling(7, min_periods=1).mean()),
        "m30": g.transform(lambda x: x.shift(1).rolling(30, min_periods=1).mean()), "lag30": g.shift(30)}).set_index("line_no").sort_index()
    assert len(got) == len(want)
    for c in want:
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True), c


def test_rolling_refuses_a_reach_beyond_the_chunk(lines):
    with pytest.raises(ValueError):
        rolling(lines, KEYS, TOTAL_ORDER, SEGMENT, 30, {}, chunk_rows=30)


def test_fill_gaps(lines, pdf):
    holes = lines.withColumn("q", F.when(F.col("line_no") % 3 == 0, F.col("qty")))
    got = by_line(fill_gaps(holes, [], TOTAL_ORDER, SEGMENT, "q", "filled"))
    q = pdf.qty.where(pdf.line_no % 3 == 0)
    want = pd.Series(q.ffill().bfill().values, index=pdf.line_no).sort_index()
    assert np.allclose(got.filled, want)


def test_quantiles_and_modes(spark):
    rows = [("a", float(v)) for v in [1, 1, 1, 2, 3, 10, 50]] + [("b", 4.0)] + [("c", None)]
    df = spark.createDataFrame(rows, "name string, value double")
    got = {r["name"]: r for r in quantiles(df, "name", "value", [0.25, 0.5, 0.9]).collect()}
    want = np.quantile([1, 1, 1, 2, 3, 10, 50], [0.25, 0.5, 0.9])
    assert np.allclose([got["a"].q0, got["a"].q1, got["a"].q2], want) and got["b"].q1 == 4.0 and "c" not in got
    ties = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None)], "name string, value string")
    assert modes(ties, "name", "value").first()["mode"] == "a"


def task_sizes(df, key):
    return np.sort([r["count"] for r in df.groupBy(key).count().collect()])


def test_ranges_cut_a_crowded_day_with_rising_ids(spark):
    """Half of the rows on one day, ids rising with time: pieces of about equal size, and positions that follow the order."""
    rows = spark.range(40_000).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 50 + 1).alias("day"), F.col("id"))
    cut = written(in_ranges(rows.repartition(8), ["day", "id"], "slot", 8), "test-ranges")
    sizes = task_sizes(cut, "slot")
    assert len(sizes) >= 4 and sizes[-1] <= 3 * np.median(sizes)
    got = with_position(cut, [], ["day", "id"], ["day", "slot"]).toPandas().sort_values("pos")
    assert (got.pos.values == np.arange(40_000)).all() and got[["day", "id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_ranked_over_crowded_scores(spark):
    df = spark.range(5000).select((1 - 1 / (F.col("id") + 1)).alias("s"), (F.col("id") % 7).alias("n"))
    got = ranked(df, ["s"], {"below": F.col("n")}).toPandas().sort_values("s")
    assert (got.below.values == np.cumsum(got.n) - got.n).all()


@pytest.mark.parametrize("accuracy", [10_000, 50, 3])
def test_quantiles_of_a_long_tail_with_an_outlier(spark, accuracy):
    """Bounds by rank: an outlier does not crowd the values into one place, and bounds that miss a rank are widened."""
    rnd = np.random.default_rng(3)
    values = [*rnd.lognormal(0, 3, 20_001).tolist(), 1e300, *[1.5] * 3000]
    df = spark.createDataFrame([("x", v) for v in values] + [("y", float(v % 10)) for v in range(999)], "name string, value double").repartition(8)
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = {r["name"]: r for r in quantiles(df, "name", "value", probs, accuracy=accuracy).collect()}
    for name, mine in (("x", values), ("y", [v % 10 for v in range(999)])):
        assert np.allclose([got[name][f"q{i}"] for i in range(5)], np.quantile(mine, probs), rtol=1e-12), name


def test_only_values_near_the_ranks_are_counted_one_by_one(spark):
    df = spark.range(200_000).select(F.lit("x").alias("name"), F.exp(F.col("id") / 500).alias("value"))
    b = spark.createDataFrame([("x", 200_000, [(float(np.exp(199.9)), float(np.exp(200.1)))])], "name string, n long, _b array<struct<lo: double, hi: double>>")
    assert _between(df, "name", "value", b).count() < 200


def test_bottom_k_takes_the_smallest_digests(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2900, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 9)).alias("month"))
    digest = F.md5(F.col("id").cast("string").cast("binary"))
    got = bottom_k(df, ["month"], F.lit(20), digest)
    assert got.columns == ["id", "month"]
    pdf = df.withColumn("d", digest).toPandas()
    want = pdf.sort_values("d").groupby("month").head(20)
    assert sorted(r["id"] for r in got.collect()) == sorted(want.id)


def test_fill_gaps_across_many_segments_of_a_day(spark):
    """A value is carried over whole segments without one."""
    df = spark.range(400).select("id", (F.col("id") / 8).cast("int").alias("slot"), F.when(F.col("id").isin(13, 200), F.col("id")).alias("v"), F.lit(1).alias("day"))
    got = [r["f"] for r in fill_gaps(df, ["day"], ["id"], ["slot"], "v", "f").orderBy("id").collect()]
    assert got == [13] * 200 + [200] * 200


@pytest.mark.parametrize("few, rows", [(10**9, 10**9), (0, 10**9), (0, 0)])
def test_running_is_the_same_by_each_way(lines, pdf, monkeypatch, few, rows):
    """Totals sent to all tasks, keys sorted whole, totals joined by a shuffle."""
    from freightloom.operators import ordered

    monkeypatch.setattr(ordered, "FEW_GROUPS", few)
    monkeypatch.setattr(ordered, "KEY_ROWS", rows)
    sets = [(KEYS, {"s": F.col("qty"), "n": F.lit(1).cast("long")}), (["department", "ship_mode"], {"l": F.col("late")})] + ([([], {"whole": F.col("qty")})] if few else [])
    got = by_line(running(lines, TOTAL_ORDER, SEGMENT, sets))
    g, d = pdf.groupby(KEYS)["qty"], pdf.groupby(["department", "ship_mode"])["late"]
    want = pd.DataFrame({"line_no": pdf.line_no, "s": g.cumsum() - pdf.qty, "n": g.cumcount(), "l": d.cumsum() - pdf.late, "whole": pdf.qty.cumsum() - pdf.qty}).set_index("line_no").sort_index()
    assert len(got) == len(want) and all(np.allclose(got[c], want[c]) for c in want if c in got)
    assert set(got.columns) >= {"s", "n", "l"}


def test_partitions_follow_the_rows(spark, tmp_path, monkeypatch):
    """A large table raises the number of shuffle partitions above the cores, and preparing the session again leaves it."""
    from freightloom import session

    monkeypatch.setattr(session, "_ROWS", {})
    monkeypatch.setattr(session, "ROWS_A_PARTITION", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.range(2050).write.parquet(f"{tmp_path}/t")
        session.sized(spark.read.parquet(f"{tmp_path}/t"), "t")
        session.prepare(spark)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "21"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fill_gaps_reads_no_frame_to_the_end(lines):
    """A frame that ends with the partition is evaluated anew for each row."""
    plan = fill_gaps(lines, [], TOTAL_ORDER, SEGMENT, "qty", "filled")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def laid(spark, lines, slots):
    """The lines in buckets by ranges of their order."""
    from freightloom.session import setting, stored_buckets
    from freightloom.sources.canonical import in_slots

    with setting(spark, "spark.sql.shuffle.partitions", "3"):
        cut = in_slots(lines.drop("slot"), lines.select("order_date", "order_id"), slots)
        return stored_buckets(spark, f"laid-{slots}", "test", "slot", lambda: cut)


@pytest.mark.parametrize("slots", [1, 9])
def test_laid_rows_are_rolled_and_summed_without_being_dealt(spark, lines, pdf, slots):
    d = laid(spark, lines, slots)
    # Ranges follow the order, and the crowded day is cut.
    assert d.select("slot").distinct().count() >= min(slots, 5)
    placed = [r.slot for r in d.orderBy(*TOTAL_ORDER).collect()]
    assert placed == sorted(placed)
    rolled = rolling(d, KEYS, TOTAL_ORDER, SEGMENT, 30, {
        "m7": lambda s: F.avg("qty").over(s.rowsBetween(-7, -1)), "m30": lambda s: F.avg("qty").over(s.rowsBetween(-30, -1)), "lag30": lambda s: F.lag("qty", 30).over(s)}, laid=["slot"], values=["qty"])
    got = by_line(rolled)
    g = pdf.groupby(KEYS)["qty"]
    want = pd.DataFrame({
        "line_no": pdf.line_no, "m7": g.transform(lambda x: x.shift(1).rolling(7, min_periods=1).mean()),
        "m30": g.transform(lambda x: x.shift(1).rolling(30, min_periods=1).mean()), "lag30": g.shift(30)}).set_index("line_no").sort_index()
    assert len(got) == len(want)
    for c in want:
        assert np.allclose(got[c].astype(float), want[c], equal_nan=True), c
    sets = [([], {"a": F.col("qty")}), (["department"], {"b": F.col("late")}, F.col("ship_mode") == "m"), (["department", "ship_mode"], {"c": F.lit(1).cast("long")})]
    summed, dealt = by_line(running(d, TOTAL_ORDER, SEGMENT, sets, laid=["slot"])), by_line(running(d, TOTAL_ORDER, SEGMENT, sets))
    for c in "abc":
        assert np.allclose(summed[c], dealt[c]), c
    with setting_of(spark):
        plan = running(d, TOTAL_ORDER, SEGMENT, sets, laid=["slot"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(order_date" not in plan and "RepartitionByExpression" not in plan


def setting_of(spark):
    from freightloom.session import setting

    return setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def test_a_task_gets_few_slots_and_small_partitions(spark):
    from freightloom.session import prepare, stored_buckets

    rows = spark.range(4000).withColumn("slot", (F.col("id") / 100).cast("int"))
    d = stored_buckets(spark, "few-slots", "test", "slot", lambda: rows, lambda: 40)
    placed = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("slot"))).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).collect()
    assert sum(r["rows"] for r in placed) == 4000 and all(r["least"] == 100 for r in placed)
    assert max(r["rows"] for r in placed) <= 500 and len(placed) > 20
    # Partitions put together stay small enough to be sorted in memory.
    assert prepare(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_many_keys_in_a_range_are_rolled_without_copies(spark):
    rows = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(400)).alias("k"), (F.col("id") / 300).cast("int").alias("slot"), (F.col("id") % 7).alias("v"))
    rows = written(rows.unionByName(rows.where("id % 100 = 0")).unionByName(rows.limit(5).withColumn("k", F.lit(None).cast("long"))), "many-keys")
    mean = lambda w: F.sum("v").over(w.rowsBetween(-30, -1))
    got = rolling(rows, ["k"], ["id", "v"], ["slot"], 30, {"m": mean}, laid=["slot"], values=["v"])
    want = rows.where("k is not null").withColumn("m", mean(Window.partitionBy("k").orderBy("id", "v")))
    seen = lambda d: sorted((r["id"], r["k"], -1 if r["m"] is None else r["m"]) for r in d.select("id", "k", "m").collect())
    assert seen(got) == seen(want)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row is copied
