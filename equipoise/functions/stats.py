"""Statistics around graphs: all aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gini(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, gini: 2 sum(i x_i) / (n sum x) - (n + 1) / n over the sorted values; equal values share their mean place, so a value is one row however often it occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(upto), F.lit(0))
    places = counts.withColumn("places", F.col("c") * before + F.col("c") * (F.col("c") + 1) / 2)
    n, total = F.sum("c"), F.sum(F.col("c") * F.col(value))
    out = places.groupBy(*by).agg(F.sum(F.col(value) * F.col("places")).alias("ix"), n.alias("n"), total.alias("x"))
    return out.select(*by, (2 * F.try_divide("ix", F.col("n") * F.col("x")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def zscores(df: DataFrame, value: str, by: list[str], name: str = "zscore") -> DataFrame:
    """df with value less its group's mean over the sample standard deviation; an aggregate joined back, so no group is one task's. Null groups match."""
    keys = [F.col(c).alias(f"__{c}") for c in by] or [F.lit(0).alias("__all")]
    sums = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__std"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] or [F.lit(0) == F.col("__all")]
    return df.join(F.broadcast(sums) if not by else sums, same).select(*df.columns, F.try_divide(F.col(value) - F.col("__mean"), F.col("__std")).alias(name))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def relative_error(x: Column, y: Column) -> Column:
    """Mean of |x - y| / |y|, as an aggregate."""
    return F.avg(F.abs(F.try_divide(x - y, y)))


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float]) -> DataFrame:
    """by, share, value: exact quantiles with linear interpolation."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("q"))
    return q.select(*by, F.posexplode("q").alias("i", "value")).select(*by, F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1).alias("share"), "value")


def regression(df: DataFrame, y: Column, x: Column, by: list[str]) -> DataFrame:
    """by, slope, intercept, r2 of a least-squares line."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def top_share(membership: DataFrame, by: list[str], cluster: str, top: int = 2) -> DataFrame:
    """by, share: what the `top` largest clusters hold of all members."""
    sizes = membership.groupBy(*by, cluster).count()
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), cluster))
    return sizes.withColumn("r", place).groupBy(*by).agg((F.sum(F.when(F.col("r") <= top, F.col("count")).otherwise(0)) / F.sum("count")).alias("share"))


def latest_interval(points: DataFrame, at: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """points with the span that holds them, the one that starts latest where spans overlap; points in none stay, with nulls, and repeated points stay repeated. spans are small (checked by the planner) or bucketed beforehand."""
    point = points.select("*", F.struct(F.monotonically_increasing_id().alias("__id"), F.struct("*").alias("__point")).alias("__row"))
    met = point.join(spans, (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)), "left")
    names = spans.columns
    best = met.groupBy("__row").agg(F.max_by(F.struct(*names), F.col(start)).alias("s"))
    return best.select("__row.__point.*", *[F.col(f"s.{c}").alias(c) for c in names])


def party(c: Column) -> Column:
    return F.when(c.isin("R", "D"), c).otherwise("O")


def first_codes(df: DataFrame, label: str, order: str, by: list[str]) -> DataFrame:
    """df with code: labels numbered from 0 by first appearance."""
    first = df.groupBy(*by, label).agg(F.min(order).alias("__first"))
    return df.join(first.withColumn("code", F.dense_rank().over(Window.partitionBy(*by).orderBy("__first")) - 1).drop("__first"), [*by, label])
