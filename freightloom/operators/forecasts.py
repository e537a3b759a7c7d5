"""Monthly and weekly cells with a moving-average forecast, the common input of the evaluation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly_cells(df: DataFrame, keys: tuple[str, ...] = ("category", "region")) -> DataFrame:
    """Demand per cell and month with the mean of the three months before as forecast.

    The window runs over the grouped table, at most one row per cell and month.
    """
    g = df.groupBy(*keys, "period").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("qty").alias("actual"),
        F.avg("late").alias("late_rate"),
        F.sum("sales").alias("revenue"),
    )
    w = Window.partitionBy(*keys).orderBy("period").rowsBetween(-3, -1)
    prior = F.when(F.count("actual").over(w) == 3, F.avg("actual").over(w))
    return g.select("*", prior.alias("forecast"))


def matched_cells(df: DataFrame, keys: tuple[str, ...] = ("category", "region")) -> DataFrame:
    return monthly_cells(df, keys).where(F.col("forecast").isNotNull())
