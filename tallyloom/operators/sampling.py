"""Deterministic sampling and resampling: every draw is a hash of a seed and a key, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, e, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *parts: Column | str) -> Column:
    return F.sha1(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def stratified(df: DataFrame, stratum: str, key: str, per: int, seed: str = "s", most: int | None = None) -> DataFrame:
    """Up to ``per`` rows of each stratum, by hash order; with ``most`` only so many of all of them, by another one."""
    k = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(seed, key), key))
    out = df.withColumn("__k", k).filter(F.col("__k") <= per).drop("__k")
    return out if most is None else out.orderBy(draw(f"{seed}{seed}", key), key).limit(most)


def orders(df: DataFrame, key: str, items: str, n: int, seed: str = "p") -> DataFrame:
    """key, canonical (the array) and orders: hash-ordered copies of it, equal ones once, the canonical one never."""
    order = lambda j: F.transform(F.array_sort(F.transform(F.col(items), lambda t: F.struct(F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), j.cast("string"), t)).alias("h"), t.alias("t")))), lambda z: z["t"])
    made = df.select(key, F.col(items).alias("canonical"), F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), order)).alias("orders"))
    return made.select(key, "canonical", F.filter("orders", lambda o: o != F.col("canonical")).alias("orders"))


def permutations(df: DataFrame, key: str, items: str, n: int, seed: str = "p") -> DataFrame:
    """key, perm_index and a hash-ordered copy of an array; equal orders of one key are kept once, the canonical one never."""
    return orders(df, key, items, n, seed).select(key, F.posexplode("orders").alias("perm_index", "evidence_order"))


def group_split(df: DataFrame, group: str, test_share: float, seed: str = "g") -> DataFrame:
    """df with split (train or test); all rows of a group fall on one side, by the group's hash."""
    u = F.conv(F.substring(draw(seed, group), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("split", F.when(u < test_share, "test").otherwise("train"))


#: Chances that a unit is drawn up to 0, 1, 2, ... times, by the rule of the Poisson distribution of mean 1.
UP_TO = [sum(1 / factorial(i) for i in range(k + 1)) / e for k in range(9)]


#: Odd multipliers of the draws' hash, below 2**31 so that a product with 32 bits fits a long in SQL, and its mask.
STEP, MIX, MASK = 0x7FEB352D, 0x45D9F3B, 0xFFFFFFFF

#: Numbers that a task draws at once, and sums that it holds before it passes them on.
AT_ONCE, HELD = 1 << 20, 1 << 22


def unit_code(seed: str, key: str) -> Column:
    """32 bits of a hash of a unit, one for all its draws."""
    return F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long")


def times_drawn(codes: np.ndarray, replicates: int) -> np.ndarray:
    """How often each unit stands in each replicate: 32 bits of code and replicate, as a Poisson number of mean 1."""
    x = codes.astype(np.uint32)[:, None] ^ (np.arange(replicates, dtype=np.uint64) * STEP & MASK).astype(np.uint32)[None, :]
    for _ in range(2):
        x = (x >> np.uint32(16) ^ x) * np.uint32(MIX)
    x ^= x >> np.uint32(16)
    return sum((x >= np.uint32(ceil(p * (MASK + 1)))).astype(np.int8) for p in UP_TO)


def weights_sql(table: str, key: str, seed: str, replicates: int) -> str:
    """The same as a common table expression ``weights`` of r, key and w."""
    x = f"SELECT r, {key}, xor(u, (r * {STEP}) & {MASK}) AS x FROM (SELECT DISTINCT {key}, ('0x' || substr(sha1('{seed}|' || {key}), 1, 8))::BIGINT AS u FROM {table}), range({replicates}) q(r)"
    for _ in range(2):
        x = f"SELECT r, {key}, (xor(x >> 16, x) * {MIX}) & {MASK} AS x FROM ({x})"
    drawn = " + ".join(f"(x >= {ceil(p * (MASK + 1))})::INT" for p in UP_TO)
    return f"weights AS (SELECT r, {key}, {drawn} AS w FROM (SELECT r, {key}, xor(x >> 16, x) AS x FROM ({x})))"


def resampled(units: DataFrame, key: str, sums: list[str], replicates: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """by, replicate and the sums of columns over a Poisson bootstrap: each unit counts as often as its hash says.

    One pass: a unit stays one row; a task adds its units to an array of sums per group, a product of matrices for some
    units at once, and passes on a row per group and replicate. Memory is bounded whatever the number of groups and
    replicates. units has a row per unit, with its sums, so that clusters are resampled whole. Null sums count nothing.
    """
    by, types = by or [], dict(units.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["replicate int"] + [f"`{c}` double" for c in sums])
    arrow = [units.select(*by).schema[c].dataType for c in by]

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        held: dict[tuple, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for group, totals in held.items():
                own = [pa.array([v] * replicates, to_arrow_type(t)) for v, t in zip(group, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(replicates, dtype=np.int32)), *map(pa.array, totals)], names=[*by, "replicate", *sums])
            held.clear()

        rows = max(1, AT_ONCE // replicates)
        for batch in batches:
            codes = batch.column("__u").to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(f"__s{i}").to_numpy(zero_copy_only=False) for i in range(len(sums))])
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * len(codes)):
                groups.setdefault(group, []).append(i)
            for group, at in groups.items():
                total = held.setdefault(group, np.zeros((len(sums), replicates)))
                for k in range(0, len(at), rows):
                    part = at[k : k + rows]
                    total += values[:, part] @ times_drawn(codes[part], replicates).astype(np.float64)
                if len(held) * len(sums) * replicates > HELD:
                    yield from passed_on()
        yield from passed_on()

    coded = units.select(*by, unit_code(seed, key).alias("__u"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__s{i}") for i, c in enumerate(sums)])
    return coded.mapInArrow(added, schema).groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in sums])


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of a row per group next to each other; without groups they have a row each."""
    return a.join(b, by, "left") if by else a.crossJoin(F.broadcast(b))


def interval(values: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """by, low and high: quantiles of the column v of replicates; null with fewer than two."""
    q = F.percentile("v", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))  # a value per replicate
    own = values.groupBy(*(by or [])).agg(F.when(F.count("v") >= 2, q).alias("q"))
    return own.select(*(by or []), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def bootstrap_mean(rows: DataFrame, value: str, cluster: str, replicates: int, seed: str = "b", by: list[str] | None = None) -> DataFrame:
    """A row per group of by: mean of a column, its interval over resampled clusters, total, n rows and n_clusters.

    Sums of whole numbers are exact in any order of rows: give money in hundredths. Rows without a value are left out. With a key of rows as cluster this is the bootstrap of independent rows.
    """
    by = by or []
    units = rows.select(*by, F.col(cluster).alias("unit"), F.col(value).cast("double").alias("s")).dropna(subset=["s"]).groupBy(*by, "unit").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    point = units.groupBy(*by).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"), F.sum("s").alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("n_clusters"))
    drawn = resampled(units, "unit", ["s", "n"], replicates, seed, by).select(*by, (F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("v"))
    return beside(point, interval(drawn, by=by), by)


def slope(rows: DataFrame, x: str, y: str, cluster: str, replicates: int, seed: str) -> DataFrame:
    """One row: slope of y on x over all rows, and its interval over resampled clusters; null without spread."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    units = rows.dropna(subset=[x, y]).groupBy(F.col(cluster).alias("unit")).agg(F.count("*").cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * b).alias("sxy"), F.sum(a * a).alias("sxx"))
    m = lambda c: F.col(c) / F.nullif(F.col("n"), F.lit(0.0))
    spread = m("sxx") - m("sx") * m("sx")
    of = F.when(spread > 1e-12, (m("sxy") - m("sx") * m("sy")) / spread)
    sums = ["n", "sx", "sy", "sxy", "sxx"]
    point = units.agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("n_clusters")).select(of.alias("slope"), "n_clusters")
    return beside(point, interval(resampled(units, "unit", sums, replicates, seed).select(of.alias("v"))), [])
