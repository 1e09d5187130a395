"""Places in the order of a number, inside groups of any size, without a task that sees a whole group.

A number has two coarse steps, of a function that never falls: a logarithm of its size with its sign, in 1024 and in
2**28 parts a power of e. They follow from the value alone, so every use of them agrees, nothing is sampled, and no job
runs while a query is declared. Counts of steps, summed in two levels, give what lies before a step; a window inside a
step gives the rest. Windows hold the values of one step, or the steps of one larger step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps(value: Column | str) -> tuple[Column, Column]:
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    u = F.signum(v) * F.log1p(F.least(F.abs(v), F.lit(1e290)) * 1e9)
    return F.floor(u * (1 << 10)), F.floor(u * (1 << 28))


def upto(n: str, by: list[str], order: str) -> Column:
    """Sum of n over the rows before this one."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def before_steps(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, __a, __b, __base (sum of n over smaller steps of the group) and all (sum over the group), from cells that have the steps and n."""
    fine = cells.groupBy(*by, "__a", "__b").agg(F.sum("n").alias("n"))
    coarse = fine.groupBy(*by, "__a").agg(F.sum("n").alias("n"))
    coarse = coarse.select(*by, "__a", upto("n", by, "__a").alias("__over"), F.sum("n").over(Window.partitionBy(*by)).alias("all"))
    inner = fine.select(*by, "__a", "__b", upto("n", [*by, "__a"], "__b").alias("__inner"))
    return inner.join(coarse, [*by, "__a"]).select(*by, "__a", "__b", (F.col("__over") + F.col("__inner")).alias("__base"), "all")


def with_steps(df: DataFrame, value: str) -> DataFrame:
    a, b = steps(value)
    return df.withColumn("__a", a).withColumn("__b", b)


def placed(df: DataFrame, by: list[str], value: str, times: str | None = None) -> DataFrame:
    """by, value, n, before and all: the distinct values of each group with their counts, the rows with smaller ones and
    the group's rows. Null values and NaN are left out, and groups with a null key. times: a column that says how many
    rows a row stands for."""
    n = F.lit(1) if times is None else F.col(times)
    rows = df.select(*by, F.col(value).alias("value"), n.cast("long").alias("n")).filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")) & (F.col("n") > 0))
    cells = with_steps(rows.groupBy(*by, "value").agg(F.sum("n").alias("n")), "value")
    at = [*by, "__a", "__b"]
    return cells.withColumn("__in", upto("n", at, "value")).join(before_steps(cells, by), at).select(*by, "value", "n", (F.col("__base") + F.col("__in")).alias("before"), "all")


def numbered(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """df with a place from 1 in its group, in the order of a number; rows without one, or with a null key, are left out.

    Each row is shuffled once, by group and step. Equal values come in any order.
    """
    rows = with_steps(df.filter(F.col(value).isNotNull()), value)
    at = [*by, "__a", "__b"]
    base = before_steps(rows.groupBy(*at).agg(F.count("*").alias("n")), by)
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(value))
    out = rows.withColumn("__in", inside).join(base, at)
    return out.select(*df.columns, (F.col("__base") + F.col("__in")).cast("int").alias(name))


def hash_placed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with a place from 0, without gaps, in an order that only the keys decide: by the first digits of their hashes
    and then by themselves, so that a window numbers one 4096th of the rows."""
    group = F.substring(F.sha1(F.col(key).cast("string").cast("binary")), 1, 3)
    rows = df.withColumn("__group", F.coalesce(group, F.lit("")))
    base = rows.groupBy("__group").agg(F.count("*").alias("n")).select("__group", upto("n", [], "__group").alias("__base"))
    inner = F.row_number().over(Window.partitionBy("__group").orderBy(key)) - 1
    return rows.withColumn("__in", inner).join(base, "__group").select(*df.columns, (F.col("__base") + F.col("__in")).alias(name))
