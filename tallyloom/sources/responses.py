"""Responses of models: meta expanded into columns, failed rows parsed again, revisions compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T

#: Keys that become columns without being declared, at most.
MOST_KEYS = 1000


def expanded(df: DataFrame, meta: str = "meta", fields: str | None = None) -> DataFrame:
    """df with its JSON column expanded into one column per key, after the others.

    ``fields`` declares keys and types (``case_id string, k int``); without it every key that occurs becomes a text
    column, in the order of names, and more than MOST_KEYS of them are an error. Keys that a row lacks are null. Nulls
    and what does not parse give nulls.
    """
    if fields is not None:
        return df.withColumn(meta, F.from_json(meta, fields)).select(*[c for c in df.columns if c != meta], f"{meta}.*")
    names = df.select(F.explode(F.json_object_keys(meta)).alias("k")).distinct().orderBy("k").limit(MOST_KEYS + 1).collect()  # the keys that occur
    if len(names) > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys in {meta}: declare the fields that are wanted")
    return df.select(*[c for c in df.columns if c != meta], *[F.get_json_object(meta, f"$['{r['k']}']").alias(r["k"]) for r in names])


def load(spark: SparkSession, path: str, model: str, task: str, fields: str | None = None) -> DataFrame:
    """The responses of one model and task from a store partitioned by both, with meta expanded; empty if there are none."""
    rows = spark.read.parquet(path).filter((F.col("model_key") == model) & (F.col("task") == task))
    return expanded(rows, "meta", fields)


def repaired(df: DataFrame, n: int) -> DataFrame:
    """df with parsed and valid, where a failed row's kept raw_text gives n probabilities after all."""
    again = F.when(F.col("parsed").isNull(), T.probabilities(F.col("raw_text"), n))
    valid = F.coalesce("valid", F.lit(False)) | (F.col("parsed").isNull() & again.isNotNull())
    return df.withColumns({"parsed": F.coalesce("parsed", again), "valid": valid})


def drift(pinned: DataFrame, live: DataFrame, key: str = "hf_id", revision: str = "revision") -> DataFrame:
    """key, pinned, live and moved: where the live revision is another than the pinned one. A key counts once, by its
    smallest pinned revision; a key without a pinned revision has not moved."""
    a = pinned.groupBy(key).agg(F.min(revision).alias("pinned"))
    b = live.groupBy(key).agg(F.min(revision).alias("live"))
    return a.join(b, key, "left").withColumn("moved", F.coalesce(F.col("pinned") != "", F.lit(False)) & ~F.col("pinned").eqNullSafe(F.col("live")))
