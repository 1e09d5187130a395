"""What figures are drawn from: densities, matrices with columns on one scale, references and extremes of curves."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def density(df: DataFrame, by: list[str], value: str, points: int = 100) -> DataFrame:
    """by, point, x and density: a Gaussian kernel estimate on a grid from a group's least to its largest value.

    The bandwidth is the sample deviation times n ** -0.2. Equal values are one row with a count before they meet the
    grid, and each task adds up what its rows give to every point. Groups without spread have no row.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    shape = rows.groupBy(*by).agg(F.count("*").alias("all"), F.min("v").alias("low"), F.max("v").alias("high"), F.stddev_samp("v").alias("deviation"))
    shape = shape.filter("deviation > 0").withColumn("width", F.col("deviation") * F.pow(F.col("all").cast("double"), F.lit(-0.2)))
    cells = rows.groupBy(*by, "v").agg(F.count("*").alias("n"))
    cells = cells.join(shape, by) if by else cells.crossJoin(F.broadcast(shape))  # one row
    grid = cells.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("width")
    return grid.groupBy(*by, "point", "x").agg(F.sum(F.col("n") * F.exp(-z * z / 2) / (F.col("all") * F.col("width") * sqrt(2 * pi))).alias("density"))


def one_scale(df: DataFrame, key: str, columns: list[str], towards: dict[str, float] | None = None) -> DataFrame:
    """key, measure and value: each column over its largest absolute value, so that 1 is the worst of all rows.

    towards: columns that are worst near a number; they enter as 1 less their distance to it over the largest distance.
    Nulls stay out. df has a row per model or group, so a window holds a column of these.
    """
    towards = towards or {}
    cell = lambda c: F.abs(F.col(c) - towards[c]) if c in towards else F.col(c).cast("double")
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), cell(c).alias("value"), F.lit(c in towards).alias("near")) for c in columns])).alias("z")).select(key, "z.*").filter("value IS NOT NULL")
    by = Window.partitionBy("measure")
    share = F.col("value") / F.nullif(F.max(F.abs("value")).over(by), F.lit(0.0))
    turned = long.withColumn("value", F.when(F.col("near"), 1 - share).otherwise(share))
    own = turned.withColumn("value", F.when(F.col("near"), F.col("value") / F.nullif(F.max(F.abs("value")).over(by), F.lit(0.0))).otherwise(F.col("value")))
    return own.select(key, "measure", "value")


def root_reference(curve: DataFrame, k: str = "k", residual: str = "residual") -> DataFrame:
    """curve with reference, what the residual of the smallest k would fall to with the root of k, and ratio to it. A row for each k."""
    every = Window.partitionBy()  # the few sizes of a curve
    first = F.min(F.struct(k, residual)).over(every)
    reference = first[residual] * F.sqrt(first[k] / F.col(k))
    return curve.withColumn("reference", reference).withColumn("ratio", F.col(residual) / F.nullif(F.col("reference"), F.lit(0.0)))


def extremes(trace: DataFrame, by: list[str], x: str, most: list[str], least: list[str]) -> DataFrame:
    """by and, for each column of most and least, x and the value where it is largest or smallest (to nine digits; of equal ones the smallest x)."""
    at = lambda c, sign: F.min_by(F.struct(x, c), F.struct(F.round(sign * F.col(c), 9), x))
    own = trace.groupBy(*by).agg(*[at(c, -1).alias(c) for c in most], *[at(c, 1).alias(c) for c in least])
    return own.select(*by, *[y for c in most + least for y in (F.col(f"{c}.{x}").alias(f"{c}_at"), F.col(f"{c}.{c}").alias(c))])
