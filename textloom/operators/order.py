"""Running sums over rows in order, without one task that holds them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neighbouring numbers that are one slice.
SLICE = 1 << 20


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column (a new one, or in the place of one) that is computed once for each row, however often it is used: no rule of the optimizer copies an expression through a generator."""
    out = df.select("*", F.explode(F.array(value)).alias("_once"))
    return out.select(*[F.col("_once").alias(c) if c == name else F.col(f"`{c}`") for c in df.columns], *([] if name in df.columns else [F.col("_once").alias(name)]))


def sliced(column: str, width: int = SLICE) -> Column:
    return F.floor(F.col(column) / width)


def running(rows: DataFrame, by: list[str], slices: list[Column], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """rows with the sum of `value` over the rows before each, in its group and order.

    `slices` cut a group's order into stretches: earlier rows never have later
    slices. Sums of whole slices are taken over one row for each, those inside a
    slice by a window of its own.
    """
    cut = [f"_slice{k}" for k in range(len(slices))]
    rows = rows.withColumns(dict(zip(cut, slices))).withColumn("_value", value)
    whole = Window.partitionBy(*by).orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, *cut).agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in [*by, *cut]], F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, *cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, *cut]])
    out = rows.join(sums, same).withColumn(name, F.col("_start") + F.col("_inside"))
    return out.drop(*sums.columns, *cut, "_value", "_inside")
