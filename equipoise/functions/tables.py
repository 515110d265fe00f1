"""Small table operations around measures: concatenation by key, places, minima, pivots and stacks, reweighted edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_concat(tables: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """Rows of all tables, by column name, with the name of the one they come from; columns that some lack are null there."""
    parts = [df.withColumn(key, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def bounds(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, low, high: the least and the greatest value."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def least_column(*names: str) -> Column:
    """The name of the column with the least value, the first of equal ones; nulls are passed over, null if all are."""
    low = F.least(*names)
    return F.coalesce(*[F.when(F.col(n) == low, F.lit(n)) for n in names])


def least_row(df: DataFrame, value: str, by: list[str], ties: list[str]) -> DataFrame:
    """The row with the least value in each group; equal ones by `ties`. An aggregate: no group is gathered."""
    rest = [c for c in df.columns if c not in by]
    best = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(value, *ties)).alias("b"))
    return best.select(*by, "b.*")


def positions(df: DataFrame, by: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """df with the place of each row in its sorted group, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def positional_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], by: list[str]) -> DataFrame:
    """Rows of both sides that have the same place in their sorted groups."""
    return positions(left, by, left_order, "__at").join(positions(right, by, right_order, "__at"), [*by, "__at"]).drop("__at")


def stacked(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, stat, value: a row for each of the named columns."""
    pairs = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.stat", "p.value")


def by_suffix(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """keys and the columns that end in the suffix, without it."""
    return df.select(*keys, *[F.col(c).alias(c.removesuffix(suffix)) for c in df.columns if c.endswith(suffix) and c not in keys])


def crossing(edges: DataFrame, groups: DataFrame, factor: float) -> DataFrame:
    """Edges whose ends lie in different groups weigh `factor` times as much; groups: (id, group). Edges with an end in no group stay."""
    a, b = (groups.select(F.col("id").alias(end), F.col("group").alias(f"__{end}")) for end in ("src", "dst"))
    met = edges.join(a, "src", "left").join(b, "dst", "left")
    return met.select("graph_id", "src", "dst", F.when(F.col("__src") != F.col("__dst"), F.col("weight") * factor).otherwise(F.col("weight")).alias("weight"))


def curve_mean(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, mean: the mean of a curve over its points; nulls are passed over."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"))
