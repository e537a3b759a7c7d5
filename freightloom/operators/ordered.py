"""Ordered computations that stay balanced when one key holds most of the rows.

A plain window sends every row of a key to one task. Here the rows of a key are cut along their
order, so a hot key is spread over many tasks:

* running totals: totals per (key, segment) are summed over earlier segments, and only the rows of one
  segment are sorted together;
* row frames of bounded reach: rows get their position within the key and are cut into chunks
  of equal size; each chunk also receives the last rows of the chunk before it.

`segment` columns must follow the order: every row of an earlier segment precedes every row of a
later one. Key and segment columns must not be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freightloom.session import written

CHUNK_ROWS = 65536


def in_ranges(df: DataFrame, order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """df dealt into ranges of `order` of about equal row count, with the number of its range; ranges follow the order.

    `ranges` fixes their number; by itself it follows the shuffle partitions, small ones put together.

    Bounds come from a sample, so the result has to be written before it is used twice. Rows equal in all of `order` stay together: end it with a key.
    """
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    return dealt.withColumn(name, F.spark_partition_id())


def ranked(df: DataFrame, order: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """df with, per measure, its sum over all rows before the row in one order over the whole table.

    The rows are cut into ranges, which are written; the totals of the ranges are summed up to offsets, and rows are sorted within a range only.
    """
    return running_before(written(in_ranges(df, order, "_range"), "ranges"), [], order, ["_range"], measures).drop("_range")


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Sequence[str],
    measures: dict[str, Column],
    base: DataFrame | None = None,
) -> DataFrame:
    """Add, per measure, its sum over the rows of the key strictly before the row (0 when none).

    `base` holds the same rows before columns were added; the segment totals are read from it, so that a chain of
    calls does not repeat the work of the earlier ones.
    """
    group = [*keys, *segment]
    totals = (base or df).groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    zero = {n: F.lit(0).cast(totals.schema[n].dataType) for n in measures}
    carry = totals.select(
        *group, *[F.coalesce(F.sum(n).over(earlier), zero[n]).alias(f"_carry_{n}") for n in measures]
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(
        "*", *[F.coalesce(F.sum(c).over(inside), zero[n]).alias(f"_part_{n}") for n, c in measures.items()]
    )
    return rows.join(carry, group).select(
        *df.columns, *[(F.col(f"_carry_{n}") + F.col(f"_part_{n}")).alias(n) for n in measures]
    )


FEW_GROUPS = 100_000  # totals of so many groups are sent to every task
KEY_ROWS = 500_000  # rows of a key that one task sorts


def running(
    df: DataFrame, order: Sequence[str], segment: Sequence[str], groups: Sequence[tuple], base: DataFrame | None = None, laid: Sequence[str] = ()
) -> DataFrame:
    """The sums of running_before for several sets of keys at once, with as few shuffles of the rows as there are; no row is dropped.

    Rows are dealt by segment once, and all sets with few keys are summed there: the totals of the segments before come to every task. Sets with many
    keys follow; they need one shuffle by their common first key, or one a set if a single key holds too many rows for a task. Where the keys or
    the segment of a row hold null its sums mean nothing: drop such rows.

    A set is (keys, measures) or (keys, measures, kept): rows that are not kept count for later segments only. The totals of segments are read from
    `base`, as in running_before; a `base` with other rows than df keeps to totals.

    `laid` names the columns, among `segment`, by which the rows lie already (see session.stored_buckets), in ranges of the order that one task sorts. Then the
    rows are not dealt at all: sums run inside these ranges, and the totals of the ranges before come to them.
    """
    same_rows, base = base is None, df if base is None else base
    groups = [(*g, F.lit(True))[:3] for g in groups]
    sizes = base.agg(*[F.approx_count_distinct(F.struct(*k, *(laid or segment))).alias(f"n{i}") for i, (k, *_) in enumerate(groups)], F.count_if(~reduce(and_, [g[2] for g in groups])).alias("left_out")).first()
    small = [g for i, g in enumerate(groups) if not g[0] or sizes[f"n{i}"] <= FEW_GROUPS]
    large = [g for g in groups if not any(g is s for s in small)]
    if laid:
        return _carried(df, order, segment, laid, groups, small, base, bool(sizes["left_out"]))
    out = _dealt(df, order, segment, small, base) if small else df
    for first in dict.fromkeys(k[0] for k, *_ in large):
        same = [g for g in large if g[0][0] == first]
        if same_rows and largest(base, [first]) <= KEY_ROWS:
            # Sorting a key's rows in one task is exact and needs no totals.
            before = lambda c, k, kept: _sum_before(c, Window.partitionBy(*k).orderBy(*order)) - (
                _sum_before(F.when(~kept, c), Window.partitionBy(*k, *segment).orderBy(*order)) if sizes["left_out"] else F.lit(0))
            out = out.repartition(first).select("*", *[before(c, k, kept).alias(n) for k, measures, kept in same for n, c in measures.items()])
        else:
            out = _dealt(out, order, segment, same, base, broadcast=False)
    return out


def largest(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _sum_before(c: Column, by: Window) -> Column:
    return F.coalesce(F.sum(c).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _dealt(df: DataFrame, order: Sequence[str], segment: Sequence[str], groups: Sequence[tuple], base: DataFrame, broadcast: bool = True) -> DataFrame:
    parts = [_sum_before(F.when(kept, c), Window.partitionBy(*k, *segment).orderBy(*order)).alias(n) for k, measures, kept in groups for n, c in measures.items()]
    out = df.repartition(*segment).select("*", *parts)
    for keys, measures, _ in groups:
        group = [*keys, *segment]
        earlier = Window.partitionBy(*keys).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
        totals = base.groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
        carry = totals.select(*group, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in measures])
        out = out.join(F.broadcast(carry) if broadcast else carry, group, "left")
        out = out.withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in measures}).drop(*[f"_carry_{n}" for n in measures])
    return out.select(*df.columns, *[n for _, measures, _ in groups for n in measures])


def _carried(
    df: DataFrame, order: Sequence[str], segment: Sequence[str], laid: Sequence[str], groups: Sequence[tuple], small: Sequence[tuple], base: DataFrame, left_out: bool
) -> DataFrame:
    """The sums of `running` for rows that lie by `laid`; totals of few groups are sent to every task, others are dealt like the rows."""
    inside = lambda c, k, kept: _sum_before(c, Window.partitionBy(*k, *laid).orderBy(*order)) - (
        _sum_before(F.when(~kept, c), Window.partitionBy(*k, *segment).orderBy(*order)) if left_out else F.lit(0))
    out = df.select("*", *[inside(c, k, kept).alias(n) for k, measures, kept in groups for n, c in measures.items()])
    for g in groups:
        keys, measures, _ = g
        group = [*keys, *laid]
        earlier = Window.partitionBy(*keys).orderBy(*laid).rowsBetween(Window.unboundedPreceding, -1)
        totals = base.groupBy(*group).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
        carry = totals.select(*group, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in measures])
        out = out.join(F.broadcast(carry) if any(g is s for s in small) else carry.hint("shuffle_hash"), group, "left")
        out = out.withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in measures}).drop(*[f"_carry_{n}" for n in measures])
    return out.select(*df.columns, *[n for _, measures, _ in groups for n in measures])


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Sequence[str], name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row within its key."""
    return running_before(df, keys, order, segment, {name: F.lit(1).cast("long")})


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Sequence[str],
    reach: int,
    frames: dict[str, Callable[[Window], Column]],
    chunk_rows: int = CHUNK_ROWS,
    position: str | None = None,
    base: DataFrame | None = None,
    laid: Sequence[str] = (),
    values: Sequence[str] = (),
) -> DataFrame:
    """Evaluate row-frame expressions that look at most `reach` rows back.

    Each value of `frames` gets the window specification and returns a column. `position` names a column with the rows' 0-based position within
    their key, if there is one; it is left out of the result. `base` is df before columns were added, to count keys on. Keys that fit a chunk are not cut.

    `laid` names the columns by which the rows lie already, as in `running`. Then no row is dealt anew: the first row of a key in a range is preceded by copies that
    hold the `values` (the columns the frames read) of the key's last `reach` rows before the range, which are found on `base`. Where keys are so many that the copies
    would outnumber the rows, only keys, places and values of the rows are dealt by key instead, and the frames come back to the rows.
    """
    if reach >= chunk_rows:
        raise ValueError("reach must be smaller than chunk_rows")
    names = [c for c in df.columns if c != position]
    if laid:
        return _rolling_laid(df.dropna(subset=[*keys, *segment]), keys, order, laid, reach, frames, values, (df if base is None else base).dropna(subset=[*keys, *segment])).select(*names, *frames)
    if largest(df if base is None else base, keys) <= chunk_rows:
        spec = Window.partitionBy(*keys).orderBy(*order)
        return df.dropna(subset=[*keys, *segment]).select(*names, *[make(spec).alias(n) for n, make in frames.items()])
    if position is None:
        placed = with_position(df, keys, order, segment, "_pos")
    else:
        placed = df.withColumnRenamed(position, "_pos").where(F.col("_pos").isNotNull())
    home = F.col("_pos") - F.col("_pos") % chunk_rows
    copies = F.when(
        F.col("_pos") % chunk_rows >= chunk_rows - reach, F.array(home, home + chunk_rows)
    ).otherwise(F.array(home))
    spread = placed.select("*", F.explode(copies).alias("_chunk"))
    spec = Window.partitionBy(*keys, "_chunk").orderBy("_pos")
    framed = spread.select("*", *[make(spec).alias(n) for n, make in frames.items()])
    return framed.where(F.col("_pos") >= F.col("_chunk")).select(*names, *frames)


def _rolling_laid(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], laid: Sequence[str], reach: int, frames: dict[str, Callable[[Window], Column]], values: Sequence[str], base: DataFrame
) -> DataFrame:
    here = Window.partitionBy(*keys, *laid)
    size = base.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.struct(*keys, *laid)).alias("groups")).first()
    if size["groups"] * reach > size["n"]:
        # Rows equal in the order may change places, as in any window; keys, range and place name one row each.
        place = F.row_number().over(here.orderBy(*order))
        narrow = base.select(*keys, *laid, *values, place.alias("_at"))
        framed = rolling(narrow, keys, [*laid, "_at"], laid, reach, frames).select(*keys, *laid, "_at", *frames)
        return df.withColumn("_at", place).join(framed.hint("shuffle_hash"), [*keys, *laid, "_at"], "left")
    last = base.withColumn("_back", F.row_number().over(here.orderBy(*[F.desc(c) for c in order]))).where(F.col("_back") <= reach)
    ends = last.groupBy(*keys, *laid).agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("_at"), *values))).alias("_ends"))
    # A range holds a row of the key at least, so the last `reach` rows before a range lie in the `reach` ranges before it.
    found = F.flatten(F.collect_list("_ends").over(Window.partitionBy(*keys).orderBy(*laid).rowsBetween(-reach, -1)))
    found = ends.select(*keys, *laid, found.alias("_found")).withColumn("_found", F.slice("_found", F.greatest(F.size("_found") - reach + 1, F.lit(1)), reach))
    one = lambda at, of: F.struct(at.cast("int").alias("_at"), *[of(v).alias(v) for v in values])
    before = found.select(*keys, *laid, F.transform("_found", lambda x, i: one(i - F.size("_found"), lambda v: x[v])).alias("_before"))
    own = F.array(one(F.lit(0), F.col))
    first = F.row_number().over(here.orderBy(*order)) == 1
    rows = df.withColumn("_first", first).join(before.hint("shuffle_hash"), [*keys, *laid], "left")
    rest = [c for c in df.columns if c not in values]
    spread = rows.select(*rest, F.explode(F.when(F.col("_first") & F.col("_before").isNotNull(), F.concat("_before", own)).otherwise(own)).alias("_x"))
    spread = spread.select(*rest, "_x.*")
    spec = here.orderBy("_at", *order)
    return spread.select("*", *[make(spec).alias(n) for n, make in frames.items()]).where("_at = 0")


def bottom_k(df: DataFrame, strata: Sequence[str], k: Column, digest: Column) -> DataFrame:
    """The k rows of each stratum with the smallest digest (a hex string of even spread, without ties), no stratum sorted whole.

    The digests below a threshold a little above k of the n rows are candidates; only they are sorted. A stratum whose candidates fall short,
    which the counts show, is taken whole instead. Strata must not be null.
    """
    names = df.columns
    placed = df.withColumn("_digest", digest)
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.least(k, F.col("_n")))
    share = (F.col("_k") + 6 * F.sqrt("_k") + 10) / F.col("_n")
    point = F.conv(F.substring("_digest", 1, 12), 16, 10).cast("double") / float(16**12)
    below = written(placed.join(sizes, list(strata)).where(point <= share).drop("_n"), "sample-candidates")
    found = below.groupBy(*strata).agg(F.count(F.lit(1)).alias("_found"))
    short = sizes.join(found, list(strata), "left").where(F.coalesce("_found", F.lit(0)) < F.col("_k")).select(*strata, "_k")
    if not short.isEmpty():
        below = below.join(short.drop("_k"), list(strata), "left_anti").unionByName(placed.join(short, list(strata)).select(*below.columns))
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest"))
    return below.withColumn("_place", place).where(F.col("_place") <= F.col("_k")).select(*names)


def quantiles(values: DataFrame, name: str, value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles per `name` of a long (name, value) table; names must be few (columns), values may be any in number and shape.

    Selection in three steps. A mergeable sketch of ranks gives each wanted rank bounds some 4 / accuracy of the rows apart, whatever the values
    are: an outlier or a long tail does not widen them. One pass counts the rows in the gaps between bounds and, one by one, the values inside them. These few
    values are ranked exactly. A rank that the sketch missed, which the counts show, is sought again between the least and the largest value.
    Returns one row per name: name, n, q0, q1, ... in the order of `probs`.
    """
    known = values.where(F.col(value).isNotNull())
    near = [min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = known.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, near, accuracy).alias("_near"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    bounds = written(sketch.select(name, "n", "_lo", "_hi", F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: F.struct(
        F.element_at("_near", 2 * i + 1).alias("lo"), F.element_at("_near", 2 * i + 2).alias("hi"))).alias("_b")), "quantile-bounds")
    counts = _between(known, name, value, bounds)
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    # A wanted rank lies inside its bounds if fewer rows are below them than the rank, and more rows up to their end.
    held = [F.min(F.when(F.col(value) >= F.col("_b")[i]["lo"], F.col("_before"))).alias(f"_s{i}") for i in range(len(probs))]
    ends = [F.max(F.when(F.col(value) <= F.col("_b")[i]["hi"], F.col("_before") + F.col("_c"))).alias(f"_e{i}") for i in range(len(probs))]
    missed = F.array(*[(F.coalesce(F.col(f"_s{i}") > F.floor(at(p)), F.lit(True)) | F.coalesce(F.col(f"_e{i}") <= F.floor(at(p)), F.lit(True))) for i, p in enumerate(probs)])
    check = counts.groupBy(name, "n").agg(*held, *ends).select(name, missed.alias("_missed"))
    if not check.where(F.array_contains("_missed", True)).isEmpty():
        wide = bounds.join(check, name).withColumn("_b", F.transform("_b", lambda b, i: F.when(
            F.element_at("_missed", i + 1), F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))).otherwise(b)))
        counts = _between(known, name, value, written(wide.drop("_missed"), "quantile-bounds"))
    picks = []
    for i, p in enumerate(probs):
        low, high = F.floor(at(p)), F.ceil(at(p))
        upto = F.col("_before") + F.col("_c")
        # The rank after `low` may be the first value beyond the bounds, which is the least of its gap.
        picks += [
            F.min(F.when(upto > low, F.col(value))).alias(f"_l{i}"), F.min(F.when(upto > high, F.col(value))).alias(f"_h{i}"), F.max(at(p) - low).alias(f"_f{i}"),
        ]
    found = counts.groupBy(name).agg(F.max("n").alias("n"), *picks)
    return found.select(
        name, "n",
        *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(f"q{i}")
          for i in range(len(probs))],
    )


def _between(known: DataFrame, name: str, value: str, bounds: DataFrame) -> DataFrame:
    """Values inside any bounds with their number `_c`, and one row for each gap between bounds with its least value; `_before` counts the rows before, per name."""
    v = F.col(value)
    inside = F.exists("_b", lambda b: (v >= b["lo"]) & (v <= b["hi"]))
    gap = F.size(F.filter("_b", lambda b: v > b["hi"]))
    # Bounds are one row a name (a column of the table), so they are small for certain.
    rows = known.join(F.broadcast(bounds), name).select(name, "n", "_b", value, gap.alias("_gap"), F.when(inside, v).alias("_one"))
    counted = rows.groupBy(name, "_gap", "_one").agg(F.count(F.lit(1)).alias("_c"), F.min(value).alias(value), F.first("n").alias("n"), F.first("_b").alias("_b"))
    placed = written(in_ranges(counted, [name, value], "_range"), "quantile-values")
    return running_before(placed, [name], [value], ["_range"], {"_before": F.col("_c")})


def modes(values: DataFrame, name: str, value: str) -> DataFrame:
    """Most frequent value per name; ties go to the smallest value."""
    counted = values.where(F.col(value).isNotNull()).groupBy(name, value).agg(F.count(F.lit(1)).alias("_c"))
    top = counted.groupBy(name).agg(F.max("_c").alias("_top"))
    return counted.join(top, name).where("_c = _top").groupBy(name).agg(
        F.min(value).alias("mode"), F.max("_c").alias("mode_count")
    )


def long_form(df: DataFrame, columns: Sequence[str], to: str = "double") -> DataFrame:
    """Unpivot columns into (column_name, value)."""
    return df.select(*[F.col(c).cast(to).alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value"
    )


def fill_gaps(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Sequence[str], column: str, name: str
) -> DataFrame:
    """Forward fill along the order, then backward fill what precedes the first known value."""
    group = [*keys, *segment]
    place = F.struct(*order)
    known = F.col(column).isNotNull()
    ends = df.groupBy(*group).agg(
        F.max_by(F.when(known, F.col(column)), F.when(known, place)).alias("_last"),
        F.min_by(F.when(known, F.col(column)), F.when(known, place)).alias("_first"),
    )
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *group,
        F.last("_last", ignorenulls=True).over(earlier(Window.partitionBy(*keys).orderBy(*segment))).alias("_from_before"),
        F.last("_first", ignorenulls=True).over(earlier(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in segment]))).alias("_from_after"),
    )
    # What comes first ahead is what comes last in the opposite order: a frame that ends with the partition would be read anew for every row.
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*group)
    rows = df.select(
        "*",
        F.last(column, ignorenulls=True).over(upto(inside.orderBy(*order))).alias("_back"),
        F.last(column, ignorenulls=True).over(upto(inside.orderBy(*[F.desc(c) for c in order]))).alias("_ahead"),
    )
    filled = F.coalesce("_back", "_from_before", "_ahead", "_from_after")
    return rows.join(carry, group).select(*df.columns, filled.alias(name))
