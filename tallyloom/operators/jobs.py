"""Jobs: what is asked of a model, a row for each question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.battery import uniform


def phased(items: DataFrame, key: str, phases: list[str], task: str) -> DataFrame:
    """items times phases, with phase, task and job_id."""
    rows = items.withColumn("phase", F.explode(F.array(*[F.lit(p) for p in phases])))
    return rows.withColumn("task", F.lit(task)).withColumn("job_id", F.concat_ws(":", F.lit(task), key, "phase"))


def answers(arms: DataFrame, key: str) -> DataFrame:
    """The items of which a single answer is asked: all but the shuffled ones."""
    rows = arms.filter("arm <> 'shuffled'")
    return rows.withColumn("job_id", F.concat_ws(":", F.lit("answer"), key, "arm", "perm_index", "replicate"))


def weight_jobs(tokens: DataFrame, formats: list[str]) -> DataFrame:
    """token, format and job_id: a job for each distinct token and format."""
    rows = tokens.select("token").distinct().withColumn("format", F.explode(F.array(*[F.lit(f) for f in formats])))
    return rows.withColumn("job_id", F.concat_ws(":", F.lit("weight"), "format", "token"))


def prior_jobs(people: DataFrame, bands: list[tuple[int, int]], sexes: list[str]) -> DataFrame:
    """lo, hi, sex, n (people of the band and sex) and job_id for each age band and sex, also where there is nobody."""
    grid = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi"), F.lit(s).alias("sex")) for a, b in bands for s in sexes])
    band = F.coalesce(*[F.when(F.col("age").between(a, b), F.lit(a)) for a, b in bands])
    n = people.select(band.alias("lo"), "sex").groupBy("lo", "sex").agg(F.count("*").alias("n"))
    rows = people.sparkSession.range(1).select(F.inline(grid)).join(n, ["lo", "sex"], "left").fillna(0, ["n"])
    return rows.withColumn("job_id", F.concat_ws(":", F.lit("prior"), "lo", "hi", "sex"))


def inserted(items: Column, new: Column, *key: Column) -> Column:
    """items with new at a place that a hash of the key picks."""
    place = F.floor(uniform(F.lit("d"), *key) * (F.size(items) + 1)).cast("int")
    return F.concat(F.slice(items, F.lit(1), place), F.array(new), F.slice(items, place + 1, F.greatest(F.size(items) - place, F.lit(0))))
