"""Robust statistics of groups. All use windows, which spill, so no group is gathered into an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tasks import tasks


def center(df: DataFrame, keys: list[str], value: str, out: str = "center") -> DataFrame:
    """Upper median of the values whose count is above the largest count less 3."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    modes = counted.withColumn("_top", F.max("_n").over(W.partitionBy(*keys))).where(F.col("_n") > F.col("_top") - 3)
    own = W.partitionBy(*keys)
    ranked = modes.withColumns({"_k": F.count("*").over(own), "_r": F.row_number().over(own.orderBy(value))})
    return ranked.where(F.col("_r") == F.floor(F.col("_k") / 2) + 1).select(*keys, F.col(value).alias(out))


def trimmed(df: DataFrame, keys: list[str], value: str, percent: int = 25) -> DataFrame:
    """The rows left when int(n / 100 * percent) are cut at either end of the sorted values."""
    own = W.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(own.orderBy(value))).withColumn("_n", F.count("*").over(own))  # one sort
    cut = F.floor(F.col("_n") / 100.0 * percent)
    return ranked.where((F.col("_r") > cut) & (F.col("_r") <= F.col("_n") - cut)).drop("_n", "_r")


def trimmed_stdev(df: DataFrame, keys: list[str], value: str, out: str = "stdev", percent: int = 25) -> DataFrame:
    """Sample standard deviation of the trimmed values; 0 for one value. ``df``: a table or stored (``tasks``)."""
    return trimmed(df.where(F.col(value).isNotNull()).repartition(tasks(df), *keys), keys, value, percent).groupBy(*keys).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(out))


def most_common(df: DataFrame, keys: list[str], value: str, out: str = "most_common", smallest: bool = False) -> DataFrame:
    """The commonest value; of several the largest, or the ``smallest``; with its ``count``."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"))
    order = W.partitionBy(*keys).orderBy(F.desc("count"), F.asc(value) if smallest else F.desc(value))
    return counted.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, F.col(value).alias(out), "count")


def int_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median cut to a whole number, mean, and mean rounded half to even."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).cast("long").alias("median"), F.avg(value).alias("mean"), F.bround(F.avg(value)).cast("long").alias("mean_rounded"))


def forward_difference_variance(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Population variance of the relative changes between neighbours: (x - previous) / previous."""
    over = W.partitionBy(*keys).orderBy(*order)
    change = df.withColumn("_p", F.lag(value).over(over)).withColumn("_c", F.try_divide(F.col(value) - F.col("_p"), F.col("_p")))
    return change.groupBy(*keys).agg(F.count("_c").alias("n"), F.coalesce(F.var_pop("_c"), F.lit(0.0)).alias("variance"))


def with_center(df: DataFrame, keys: list[str], value: str, out: str) -> tuple[DataFrame, Column]:
    """``df`` with columns from which the aggregate over ``keys`` gives ``center`` of ``value`` (never null), without another exchange.

    All its windows, and those of ``with_trimmed``, take one sort by the keys and the value: the one that
    needs it comes first, and after it nothing is ordered by anything else.
    """
    own = W.partitionBy(*keys)
    count, place, top = f"_{out}_n", f"_{out}_k", f"_{out}_r"
    x = df.withColumn(place, ~F.lag(value).over(own.orderBy(value)).eqNullSafe(F.col(value)))
    x = x.withColumn(count, F.count("*").over(W.partitionBy(*keys, value)))
    x = x.withColumn(top, F.max(count).over(own))
    x = x.withColumn(place, F.when(F.col(place) & (F.col(count) > F.col(top) - 3), 1).otherwise(0))
    x = x.withColumn(top, F.sum(place).over(own.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn(count, F.sum(place).over(own))
    return x, F.max(F.when((F.col(place) == 1) & (F.col(top) == F.floor(F.col(count) / 2) + 1), F.col(value))).alias(out)


def with_trimmed(df: DataFrame, keys: list[str], value: str, out: str, percent: int = 25) -> tuple[DataFrame, Column]:
    """``df`` with columns from which the aggregate over ``keys`` gives ``trimmed_stdev`` of ``value`` (never null)."""
    own = W.partitionBy(*keys)
    n, r = f"_{out}_n", f"_{out}_r"
    x = df.withColumn(r, F.row_number().over(own.orderBy(value))).withColumn(n, F.count("*").over(own))
    cut = F.floor(F.col(n) / 100.0 * percent)
    return x, F.coalesce(F.stddev_samp(F.when((F.col(r) > cut) & (F.col(r) <= F.col(n) - cut), F.col(value))), F.lit(0.0)).alias(out)
