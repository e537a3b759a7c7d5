"""Historical features of order lines that see only rows strictly before the row they describe.

Rows are ordered by one explicit total order, so the features do not depend on file order or ties.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightloom.functions.scalars import clip
from freightloom.operators.ordered import rolling, running, running_before
from freightloom.sources import TOTAL_ORDER

SEGMENT = ["order_date", "slot"]
RANGE = ["slot"]  # the rows kept with slots lie by them
CELL = ["category", "region"]


def before(
    df: DataFrame, keys: Sequence[str], measures: dict[str, Column], base: DataFrame | None = None
) -> DataFrame:
    return running_before(df, keys, TOTAL_ORDER, SEGMENT, measures, base)


def one_if(column: str) -> Column:
    return F.col(column).isNotNull().cast("long")


def with_prior(df: DataFrame, value: str, prior: str, base: DataFrame) -> DataFrame:
    """Mean of all rows strictly before, 0.5 for the first one."""
    d = before(df, [], {"_ps": F.col(value), "_pn": one_if(value)}, base)
    return d.withColumn(prior, F.coalesce(F.try_divide("_ps", "_pn"), F.lit(0.5))).drop("_ps", "_pn")


def expanding_means(
    df: DataFrame, value: str, groups: dict[str, Sequence[str]], min_rows: int, compat: bool = False,
    base: DataFrame | None = None,
) -> DataFrame:
    """One column per entry of `groups`: mean of `value` over earlier rows of the same keys.

    With fewer than `min_rows` earlier rows the mean over all earlier rows stands in. `compat` gives the leaky
    variant instead, whose stand-in is the group mean including the row itself.
    """
    sets = rate_sums(value, groups, compat)
    out = running(df, TOTAL_ORDER, SEGMENT, sets, base).dropna(subset=list(dict.fromkeys([*SEGMENT, *[k for keys in groups.values() for k in keys]])))
    return rates(out, value, groups, min_rows, compat)


def known(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns], F.lit(True))


def rate_sums(value: str, groups: dict[str, Sequence[str]], compat: bool = False, needed: Sequence[str] = ()) -> list[tuple]:
    """The running sums `rates` reads: of each group, and of all rows unless `compat`. Rows without one of `needed` or a key of a group before are not kept."""
    sets, needed = [] if compat else [([], {"_ps": F.col(value), "_pn": one_if(value)}, known(needed))], list(needed)
    for n, keys in groups.items():
        sets.append((keys, {f"_s_{n}": F.col(value), f"_n_{n}": one_if(value)}, known(needed)))
        needed += keys
    return sets


def rates(sums: DataFrame, value: str, groups: dict[str, Sequence[str]], min_rows: int, compat: bool = False) -> DataFrame:
    prior = F.coalesce(F.try_divide("_ps", "_pn"), F.lit(0.5))
    means = {}
    for n in groups:
        stand_in = (F.col(f"_s_{n}") + F.col(value)) / (F.col(f"_n_{n}") + 1) if compat else prior
        means[n] = F.when(F.col(f"_n_{n}") >= min_rows, F.try_divide(f"_s_{n}", f"_n_{n}")).otherwise(stand_in)
    return sums.withColumns(means).drop("_ps", "_pn", *[f"_{c}_{n}" for n in groups for c in "sn"])


def share_before(df: DataFrame, keys: Sequence[str], name: str, base: DataFrame) -> DataFrame:
    """Share of the earlier rows that have the keys of the row."""
    one = F.lit(1).cast("long")
    d = running(df, TOTAL_ORDER, SEGMENT, [(keys, {"_k": one}), ([], {"_all": one}, known(keys))], base).dropna(subset=[*keys, *SEGMENT])
    return d.withColumn(name, F.coalesce(F.try_divide("_k", "_all"), F.lit(0.0))).drop("_k", "_all")


def expanding_target_rate(df: DataFrame, keys: Sequence[str], compat: bool = False) -> DataFrame:
    return expanding_means(df, "late", {"rate": keys}, 30, compat)


def supplier_rates(df: DataFrame) -> DataFrame:
    d = expanding_means(
        df, "late",
        {"supplier_hist_late_rate": ["department", "ship_mode"], "supplier_delay_rate": ["department"]}, 30,
    )
    return d.withColumn("supplier_reliability_score", clip(1 - F.col("supplier_hist_late_rate"), 0.0, 1.0)).withColumn(
        "supplier_risk_index",
        clip(F.col("supplier_delay_rate") * 0.6 + (1 - F.col("supplier_reliability_score")) * 0.4, 0.0, 1.0),
    )


def route_rates(df: DataFrame) -> DataFrame:
    return expanding_means(
        df, "late",
        {"route_hist_late_rate": ["ship_mode", "region"], "region_hist_late_rate": ["region"],
         "shipmode_hist_late_rate": ["ship_mode"]}, 30,
    )


def _std(spec, n: int, value: str) -> Column:
    w = spec.rowsBetween(-n, -1)
    return F.when(F.count(value).over(w) >= 2, F.stddev_samp(value).over(w)).otherwise(0.0)


def demand_frames(df: DataFrame, value: str = "qty", keys: Sequence[str] = CELL, position: str | None = None, base: DataFrame | None = None, laid: Sequence[str] = ()) -> DataFrame:
    """Rolling means, deviations and lags of the demand of a cell, the row itself excluded. `position`, `base` and `laid` as in rolling."""
    return rolling(df, keys, TOTAL_ORDER, SEGMENT, 30, {
        "qty_roll_7": lambda s: F.avg(value).over(s.rowsBetween(-7, -1)),
        "qty_roll_30": lambda s: F.avg(value).over(s.rowsBetween(-30, -1)),
        "qty_std_14": lambda s: _std(s, 14, value),
        "qty_std_30": lambda s: _std(s, 30, value),
        "qty_prev": lambda s: F.lag(value, 1).over(s),
        "qty_back_7": lambda s: F.lag(value, 7).over(s),
        "qty_back_30": lambda s: F.lag(value, 30).over(s),
        # includes the row itself: it is the scale of the row's own quantity, not a target
        "qty_mean_14": lambda s: F.avg(value).over(s.rowsBetween(-13, 0)),
    }, position=position, base=base, laid=laid, values=[value])


def lag_features(df: DataFrame, value: str = "qty", keys: Sequence[str] = CELL) -> DataFrame:
    """Lags 1, 7, 30; rows without that much history get the mean of the cell."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    d = demand_frames(df, value, keys).join(means, list(keys))
    return d.withColumns({
        f"qty_lag_{n}": F.coalesce(F.col(c), F.col("_mean"))
        for n, c in ((1, "qty_prev"), (7, "qty_back_7"), (30, "qty_back_30"))
    }).drop("_mean")


def _safe(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == 0), 1.0).otherwise(F.col(c))


def _bounded(c: Column, low: float, high: float, default: float) -> Column:
    """Clip; a missing value becomes the default (greatest and least alone would skip it)."""
    return F.when(c.isNull(), default).otherwise(clip(c, low, high))


def demand_signals(frames: DataFrame) -> DataFrame:
    m30 = _safe("qty_roll_30")
    return frames.withColumns({
        "demand_volatility": clip(F.col("qty_std_30") / m30, 0.0, 5.0),
        "demand_trend": _bounded((F.col("qty_roll_7") - F.col("qty_roll_30")) / m30, -2.0, 3.0, 0.0),
        "demand_momentum": _bounded(F.col("qty_roll_7") / m30, 0.0, 3.0, 1.0),
        "demand_spike_flag": F.coalesce(
            F.col("qty_prev") > F.col("qty_roll_7") + 2 * F.col("qty_std_14"), F.lit(False)
        ).cast("int"),
    })


def inventory_signals(frames: DataFrame, value: str = "qty") -> DataFrame:
    m14, m30 = _safe("qty_mean_14"), _safe("qty_roll_30")
    return frames.withColumns({
        "inventory_stress_index": _bounded(F.col(value) / m14, 0.0, 3.0, 0.5),
        "days_until_reorder": _bounded(14 - 7 * (F.col("qty_roll_7") / m30), 0.0, 21.0, 14.0),
        "reorder_point": F.coalesce(F.col("qty_roll_7") * 1.5, F.lit(0.0)),
        "stock_coverage_ratio": _bounded(F.col("qty_roll_30") / m14, 0.1, 10.0, 1.0),
    })


def category_demand_rank(df: DataFrame) -> DataFrame:
    """Expanding category mean scaled by the largest of them."""
    d = expanding_means(df, "qty", {"_mean": ["category"]}, 1)
    top = d.agg(F.greatest(F.max("_mean"), F.lit(1.0)).alias("m")).scalar()
    return d.withColumn("category_demand_rank", clip(F.col("_mean") / top, 0.0, 1.0)).drop("_mean")


def frequency_encode(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the largest group (whole frame) and, for models, the share among earlier rows only."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.agg(F.max("_n").alias("m")).scalar()
    full = counts.select(*keys, (F.col("_n") / top).alias("frequency_full"))
    return share_before(df, keys, "frequency_as_of", df).join(full, list(keys))


def diversity_encode(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct values per key over the largest such count, per key."""
    g = df.groupBy(key).agg(F.count_distinct(value).alias("n_distinct"))
    return g.withColumn("diversity", F.col("n_distinct") / g.agg(F.max("n_distinct")).scalar())


def graph_context_tier1(df: DataFrame) -> DataFrame:
    """Stand-ins for the graph features made of earlier rows only."""
    stressed = inventory_signals(demand_frames(df))
    d = expanding_means(stressed, "inventory_stress_index", {"graph_inventory_stress": CELL}, 10)
    d = expanding_means(d, "late", {"graph_avg_shipping_delay": ["ship_mode", "region"]}, 10, base=df)
    d = expanding_means(d, "late", {"_rate": ["department", "ship_mode"]}, 30, base=df)
    d = share_before(d, ["department", "ship_mode"], "graph_edge_density", df)
    return d.withColumn("graph_supplier_reliability", clip(1 - F.col("_rate"), 0.0, 1.0)).drop("_rate")


def anchored_features(history: DataFrame, new: DataFrame) -> DataFrame:
    """Features of new rows computed with the history in frame; only the new rows come back."""
    both = history.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return demand_signals(demand_frames(both)).where("_new").drop("_new")
