"""What the operators of this subpackage share: scratch tables, bounded broadcasts, prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of rows that may be broadcast; every table broadcast here has a few short columns.
MAX_BROADCAST_ROWS = 200_000

#: A key is hot if it holds at least this part of all rows: there are never more hot keys than this.
HOT_PART = 2000

#: The characters that separate words: space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names; a local temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written in the innermost open ``tidied`` block of this thread (or task of asyncio).
_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def _noted(spark: SparkSession, name: str) -> str:
    """A scratch path that the open block, if there is one, deletes at its end."""
    path, block = scratch_path(spark, name), _OPEN.get()
    if block is not None:
        block.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = _noted(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``written``, dealt to buckets by a key: joins of such tables with as many buckets on this key need no shuffle."""
    spark = df.sparkSession
    path, table = _noted(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay: they lie outside the warehouse
    out.scratch = path
    return out


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders, wherever the shared folder is."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """A block at whose end the tables written in it are deleted, but for those appended to what it yields.

    What the block returns may read only those. They go to the block around it, if there is one.
    """
    kept: list[DataFrame] = []
    around, own = _OPEN.get(), []
    token = _OPEN.set(own)
    try:
        yield kept
    finally:
        _OPEN.reset(token)
        stay = {df.scratch for df in kept}
        removed(spark, *[p for p in own if p not in stay])
        if around is not None:
            around += [p for p in own if p in stay]


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has few enough rows, else as it is: Spark then shuffles both sides."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def hot_join(rows: DataFrame, lookup: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) with a table that has each key once and a column ``hot``, true for at most HOT_PART of its keys.

    Rows with a hot key meet it by a broadcast of those keys and are never shuffled; the others are dealt by key. The
    hashes of the hot keys, a bounded list, tell on either side which way a row goes.
    """
    code = F.xxhash64(*key)
    hot = [r[0] for r in lookup.filter("hot").select(code).collect()]  # at most HOT_PART
    lookup = lookup.drop("hot")
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.coalesce(code.isin(hot), F.lit(False))
    return rows.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), key, how).unionByName(rows.filter(~is_hot).join(lookup.filter(~is_hot), key, how))


def exclusive_sum(value: str, order: list[str]) -> Column:
    """Sum of the rows before this one, over a table with a row per partition or bucket."""
    return F.coalesce(F.sum(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def narrowed(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names: extra columns can't clash with an operator's own."""
    return docs.select(*[docs[old].alias(new) for new, old in columns.items()])


def dense_rank_table(keys: DataFrame, key: str, partitions: int) -> tuple[DataFrame, int]:
    """Distinct keys with positions from 0 in their order, and their count.

    Keys are range-partitioned and written with their partition's number; partition counts give offsets, and a
    window inside each partition gives the rest, so no task sees more than one range.
    """
    part = (
        keys.select(key).distinct().repartitionByRange(partitions, F.col(key).asc_nulls_first()).withColumn("part", F.spark_partition_id())
    )
    part = written(part, "ranges")
    counts = part.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", exclusive_sum("n", ["part"]).alias("before"), "n")
    rows = part.count()
    ranked = part.join(small(offsets.drop("n"), partitions), "part").select(
        key, (F.row_number().over(Window.partitionBy("part").orderBy(F.col(key).asc_nulls_first())) - 1 + F.col("before")).alias("position")
    )
    return ranked, rows
