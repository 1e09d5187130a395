"""Typed ingest, and runs of jobs in chunks that can be stopped anywhere and resumed."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.ranges import hash_placed

#: A text in single or double quotes with backslash escapes, a number, and what stands for one of them in a cell's outline.
TEXT = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+\""""
NUMBER = r"[-+]?(?:\d++\.?\d*+|\.\d++)(?:[eE][-+]?\d++)?+"
MARK = "\x01"

#: Escapes in quoted texts and what they stand for; a doubled backslash is taken first.
ESCAPES = [("'", "'"), ('"', '"'), ("n", "\n"), ("t", "\t"), ("r", "\r")]


def unquoted(text: Column) -> Column:
    """The text inside a pair of quotes, with its escapes undone."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)

    def undone(part: Column) -> Column:
        for mark, value in ESCAPES:
            part = F.replace(part, F.lit("\\" + mark), F.lit(value))
        return part

    return F.array_join(F.transform(F.split(inner, r"\\\\"), undone), "\\")


def items_of(cell: Column, item: str) -> Column:
    """The items of a list in brackets, as they are written; null if the cell is anything else than such a list."""
    outline = F.regexp_replace(F.regexp_replace(cell, item, MARK), r"\s", "")
    inside = F.replace(F.substring(outline, F.lit(2), F.length(outline) - 2), F.lit(MARK + ","), F.lit(""))
    whole = F.startswith(outline, F.lit("[")) & F.endswith(outline, F.lit("]")) & inside.isin("", MARK) & ~F.contains(cell, F.lit(MARK))
    return F.when(whole, F.regexp_extract_all(cell, F.lit(item), F.lit(0)))


def listed(cell: Column, kind: str) -> Column:
    """A cell like ``['a', "it's"]``, ``[1, 2.5]`` or ``[('a', 0.5), ['b', 1]]`` as an array of texts, numbers or records.

    Texts stand in either kind of quotes, with backslash escapes; records hold a text and a number in round or square
    brackets. A comma may follow the last item. Null cells and all that is no such list are null.
    """
    inner = kind[len("array<") : -1].strip()
    if inner == "string":
        return F.transform(items_of(cell, TEXT), unquoted)
    if not inner.startswith("struct<"):
        return F.transform(items_of(cell, NUMBER), lambda x: x.try_cast(inner))
    record = rf"[\[(]\s*+(?:{TEXT})\s*+,\s*+{NUMBER}\s*+[\])]"
    number = rf"({NUMBER})\s*+[\])]$"
    parts = F.transform(items_of(cell, record), lambda x: F.struct(unquoted(F.regexp_extract(x, f"({TEXT})", 1)), F.regexp_extract(x, number, 1).try_cast("double")))
    return parts.cast(kind)


def typed_csv(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """A CSV file with header, read as text and cast column by column; lists as ``listed`` reads them. What doesn't fit is null."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[(listed(F.col(c), t) if t.startswith("array") else F.col(c).try_cast(t)).alias(c) for c, t in types.items()])


def ingest(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Writes df as zstd Parquet unless it is there already, and reads it."""
    df.write.mode("overwrite" if force else "ignore").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pending(jobs: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Jobs without a stored response."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def store(responses: DataFrame, path: str) -> None:
    """Writes responses by model, task and chunk; a chunk that is written again replaces itself only. Columns that hold
    nothing but nulls are written as text."""
    typed = responses.select(*[F.col(c).cast("string").alias(c) if t == "void" else c for c, t in responses.dtypes])
    typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_key", "task", "chunk_id").parquet(path)


#: Kinds of numbers, each of which holds the ones before it.
NUMBERS = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds the values of both: void < any, whole numbers < double, arrays by their elements, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    a, b = (T.DoubleType() if isinstance(x, (T.FloatType, T.DecimalType)) else x for x in (a, b))
    if type(a) in NUMBERS and type(b) in NUMBERS:
        return max(a, b, key=lambda x: NUMBERS.index(type(x)))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    return a if a == b else T.StringType()


def merged(*shards: DataFrame) -> DataFrame:
    """One table of shards whose columns or types differ: missing columns are null, types are widened.

    Columns stand in the order in which the shards bring them.
    """
    types: dict[str, T.DataType] = {}
    for s in shards:
        for f in s.schema.fields:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    as_text = lambda s, c, t: F.to_json(c) if isinstance(t, T.StringType) and isinstance(s.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c).cast(t)
    cast = [s.select(*[(as_text(s, c, t) if c in s.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()]) for s in shards]
    out, *rest = cast
    for s in rest:
        out = out.unionByName(s)
    return out


def folders(spark: SparkSession, path: str, *levels: str) -> list[tuple]:
    """Values of the partition columns of a store, from the names of its folders alone: no file is opened.

    A folder counts if it holds anything but hidden files. Sorted; the null partition gives None.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "".join(f"/{c}=*" for c in levels))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    value = lambda name: None if name == "__HIVE_DEFAULT_PARTITION__" else unquote(name)
    out = []
    for found in fs.globStatus(at) or []:
        where = found.getPath()
        if any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(where)):
            names = str(where.toString()).split("/")[-len(levels) :]
            out.append(tuple(value(n.split("=", 1)[1]) for n in names))
    return sorted(out, key=str)


def completed_tasks(spark: SparkSession, path: str) -> DataFrame:
    """model_key and task of what has responses in a store, from the names of its folders."""
    return spark.createDataFrame(folders(spark, path, "model_key", "task"), "model_key string, task string")


def chunked(jobs: DataFrame, key: str, size: int) -> DataFrame:
    """jobs with place (from 0, without gaps) and chunk_id, ``size`` places each, in an order that only the keys decide."""
    return hash_placed(jobs, key, "place").withColumn("chunk_id", F.expr(f"place div {size}"))


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_task(jobs: DataFrame, root: str, model: str, task: str, answer: Callable[[DataFrame], DataFrame], key: str = "item_id", size: int = 2000, at_once: int = 50) -> DataFrame:
    """The responses of a task, run in chunks: answer takes jobs with place and chunk_id and returns rows that keep them.

    Chunks whose folder is there are not run again, so a run that broke off goes on where it stopped; ``at_once`` chunks
    are one Spark job and become durable together. When none is left the chunks are merged into one table, in the order
    of chunks and places, with types widened where they differ, and deleted. A task that is complete is only read.
    Running it again, after an end at any point, changes nothing. Jobs must be the same each time; keys decide chunks.
    """
    spark = jobs.sparkSession
    shards, final = f"{root}/shards", f"{root}/responses/model_key={model}/task={task}"
    own = f"{shards}/model_key={model}/task={task}"
    if not exists(spark, f"{final}/_SUCCESS"):
        numbered = chunked(jobs, key, size)
        wanted = [r["chunk_id"] for r in numbered.select("chunk_id").distinct().orderBy("chunk_id").collect()]  # a number per chunk
        done = {int(c) for m, t, c in folders(spark, shards, "model_key", "task", "chunk_id") if (m, t) == (model, task)}
        left = [c for c in wanted if c not in done]
        for i in range(0, len(left), at_once):
            rows = answer(numbered.filter(F.col("chunk_id").isin(left[i : i + at_once])))
            store(rows.withColumns({"model_key": F.lit(model), "task": F.lit(task)}), shards)
        if not wanted:
            out = answer(numbered)  # no jobs: an empty table
        else:
            out = merged(*by_schema(spark, own, wanted)).repartitionByRange("chunk_id", "place").sortWithinPartitions("chunk_id", "place")
        out.drop("chunk_id", "place").write.mode("overwrite").option("compression", "zstd").parquet(final)
    removed(spark, own)
    return spark.read.parquet(final)


def by_schema(spark: SparkSession, path: str, chunks: list[int]) -> list[DataFrame]:
    """The chunks of a task, those of one schema as one table, in the order of their first chunks."""
    groups: dict[str, list[str]] = {}
    for c in chunks:
        at = f"{path}/chunk_id={c}"
        groups.setdefault(spark.read.parquet(at).schema.json(), []).append(at)  # a footer
    return [spark.read.option("basePath", path).parquet(*paths).withColumn("chunk_id", F.col("chunk_id").cast("long")) for paths in groups.values()]
