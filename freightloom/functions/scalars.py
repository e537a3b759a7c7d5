"""Column functions shared by the operators; all of them stay native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low, high) -> Column:
    return F.greatest(F.least(col(c), F.lit(high)), F.lit(low))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero."""
    return F.try_divide(col(a), col(b))


def risk_label(c: str | Column) -> Column:
    c = col(c)
    return F.when(c >= 0.75, "critical").when(c >= 0.50, "high").when(c >= 0.25, "medium").otherwise("low")


def risk_label_3(c: str | Column, high: float = 0.65, medium: float = 0.35) -> Column:
    c = col(c)
    return F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")


def change_pct(current: str | Column, previous: str | Column) -> Column:
    """Percentage change; from a previous value of 0 it is 0 or 100."""
    c, p = col(current), col(previous)
    return (
        F.when((p == 0) & (c == 0), 0.0).when(p == 0, 100.0).otherwise(F.try_divide(c - p, F.abs(p)) * 100)
    )


def first_positive(*columns: str | Column) -> Column:
    """First of the columns that is above zero, else 0."""
    return F.coalesce(*[F.when(col(c) > 0, col(c)) for c in columns], F.lit(0.0))


def safe_double(c: str | Column, default: float = 0.0) -> Column:
    """Text or number to double; bad, missing and non-finite values become the default."""
    v = col(c).try_cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(v)


def normalize_entity(c: str | Column) -> Column:
    """Trim, underscores to blanks, double blanks to one, title case; null when nothing is left."""
    words = F.replace(F.replace(F.lower(F.trim(col(c))), F.lit("_"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.nullif(F.initcap(words), F.lit(""))


def slugify(c: str | Column) -> Column:
    return F.translate(F.lower(normalize_entity(c)), " -", "__")


def node_id(label: str | Column, key: str | Column) -> Column:
    """12 hex digits of the md5 of 'label:key'."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.substring(F.md5(F.concat_ws(":", label, col(key).cast("string")).cast("binary")), 1, 12)
