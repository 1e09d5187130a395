import ast
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources import store as S

CELLS = ["['x', 'y']", "[]", """["it's", 'a']""", r"['a\'b', 'c\\', 'd\ne']", r"""["q\"q", "\\n"]""", " [ 'one' , ]", "['é', '']", "['a' 'b']", "['a', b]", "['a'", "x", "", None, "['a', 'b']]", "[1]", "['" + "w " * 5000 + "', " * 1]


def literal(cell, kind):
    try:
        out = ast.literal_eval(cell.strip())
    except Exception:
        return None
    return out if isinstance(out, list) and all(isinstance(x, kind) for x in out) else None


def test_lists_in_cells(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string").withColumn("x", S.listed(F.col("c"), "array<string>"))
    got = {r.i: r.x for r in df.collect()}
    for i, c in enumerate(CELLS):
        want = None if c in ("['a' 'b']",) else literal(c, str) if c is not None else None  # adjacent texts are no list here
        assert got[i] == want, c
    numbers = ["[1, 2.5, -3e2]", "[]", "[1,]", "[.5]", "[a]", "['1']"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(numbers)), "i int, c string").withColumn("x", S.listed(F.col("c"), "array<double>")).orderBy("i").collect()]
    assert got == [literal(c, (int, float)) for c in numbers]
    pairs = ["[('a', 0.5), ['it\\'s', 1]]", "[]", "[('a')]"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(pairs)), "i int, c string").withColumn("x", S.listed(F.col("c"), "array<struct<name:string,p:double>>")).orderBy("i").collect()]
    assert [x if x is None else [tuple(p) for p in x] for x in got] == [[("a", 0.5), ("it's", 1.0)], [], None]


def test_ingest_skips_and_forces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,age,tokens\n1,30,\"['x', 'y']\"\n2,old,[]\n3,4,\"[\"\"it's\"\", 'a']\"\n")
    read = lambda: S.typed_csv(spark, str(tmp_path / "a.csv"), {"id": "bigint", "age": "int", "tokens": "array<string>"})
    assert [tuple(r) for r in read().orderBy("id").collect()] == [(1, 30, ["x", "y"]), (2, None, []), (3, 4, ["it's", "a"])]
    at = str(tmp_path / "t")
    assert S.ingest(read(), at).count() == 3
    (tmp_path / "a.csv").write_text("id,age,tokens\n9,1,[]\n")
    assert S.ingest(read(), at).count() == 3  # it is there already
    assert [r.id for r in S.ingest(read(), at, force=True).collect()] == [9]


def test_store(spark, tmp_path):
    path = str(tmp_path / "r")
    make = lambda chunk, items, task="a1": spark.createDataFrame([("m", task, chunk, i) for i in items], "model_key string, task string, chunk_id int, item_id int")
    S.store(make(0, [1, 2]).withColumn("raw_text", F.lit(None)), path)
    S.store(make(1, [3]), path)
    S.store(make(0, [1, 2, 4]), path)
    S.store(make(0, [1], "a/2 =x"), path)
    done = spark.read.parquet(path)
    assert sorted(r.item_id for r in done.collect()) == [1, 1, 2, 3, 4]
    assert [r.item_id for r in S.pending(make(0, [4, 5]), done).collect()] == [5]
    assert sorted(map(tuple, S.completed_tasks(spark, path).collect())) == [("m", "a/2 =x"), ("m", "a1")]
    assert S.completed_tasks(spark, str(tmp_path / "none")).count() == 0


def test_tasks_are_told_without_opening_files(spark, tmp_path):
    for name in ("model_key=m/task=a1/chunk_id=0", "model_key=m/task=empty", "model_key=n/task=b"):
        (tmp_path / name).mkdir(parents=True)
    (tmp_path / "model_key=m/task=a1/chunk_id=0/x.parquet").write_bytes(b"no parquet")
    (tmp_path / "model_key=n/task=b/part.parquet").write_bytes(b"nor this")
    (tmp_path / "model_key=m/task=empty/_temporary").write_bytes(b"")
    assert sorted(map(tuple, S.completed_tasks(spark, str(tmp_path)).collect())) == [("m", "a1"), ("n", "b")]


def test_types_are_widened(spark):
    assert S.wider(T.NullType(), T.StringType()) == T.StringType() and S.wider(T.IntegerType(), T.LongType()) == T.LongType()
    assert S.wider(T.LongType(), T.DoubleType()) == T.DoubleType() and S.wider(T.DoubleType(), T.StringType()) == T.StringType() and S.wider(T.BooleanType(), T.IntegerType()) == T.StringType()
    assert S.wider(T.ArrayType(T.NullType()), T.ArrayType(T.FloatType())) == T.ArrayType(T.FloatType())
    a = spark.createDataFrame([(1, 2)], "id int, v int").withColumn("raw_text", F.lit(None)).withColumn("p", F.array())
    b = spark.createDataFrame([(2**40, 0.5, "why", [0.25])], "id long, v double, raw_text string, p array<double>")
    c = spark.createDataFrame([(3, "x", True)], "id int, v string, only boolean")
    out = S.merged(a, b, c)
    assert out.dtypes == [("id", "bigint"), ("v", "string"), ("raw_text", "string"), ("p", "array<double>"), ("only", "boolean")]
    assert sorted(map(tuple, out.collect())) == [(1, "2", None, [], None), (3, "x", None, None, True), (2**40, "0.5", "why", [0.25], None)]


def test_interrupted_runs_equal_whole_ones(spark, tmp_path):
    jobs = spark.createDataFrame([(f"job{i}", i) for i in range(53)], "item_id string, x int")
    ran = []

    def answer(df, fail_from=99):
        ids = sorted({r.chunk_id for r in df.select("chunk_id").collect()})
        ran.extend(ids)
        if ids and ids[0] >= fail_from:
            raise RuntimeError("the engine died")
        text = F.when(F.col("x") % 2 == 0, F.lit("failed")) if any(c % 4 == 0 for c in ids) else F.lit(None)
        return df.withColumn("y", F.col("x") * 2).withColumn("raw_text", text)

    rows = lambda df: sorted(map(str, df.drop("raw_text").collect()))
    whole = S.run_task(jobs, str(tmp_path / "a"), "m", "t", answer, size=5, at_once=2)
    assert whole.count() == 53 and len(set(ran)) == 11 and dict(whole.dtypes)["raw_text"] == "string"
    ran.clear()
    with pytest.raises(RuntimeError):
        S.run_task(jobs, str(tmp_path / "b"), "m", "t", lambda df: answer(df, 4), size=5, at_once=2)
    assert ran == [0, 1, 2, 3, 4, 5] and not S.exists(spark, str(tmp_path / "b/responses"))
    ran.clear()
    resumed = S.run_task(jobs, str(tmp_path / "b"), "m", "t", answer, size=5, at_once=2)
    assert ran == [4, 5, 6, 7, 8, 9, 10] and rows(resumed) == rows(whole)
    assert not S.exists(spark, str(tmp_path / "b/shards/model_key=m/task=t"))
    # order: files hold chunks in order
    order = {r.item_id: (r.chunk_id, r.place) for r in S.chunked(jobs, "item_id", 5).collect()}
    assert sorted(p for _, p in order.values()) == list(range(53)) and all(p // 5 == c for c, p in order.values())
    assert [order[r.item_id] for r in resumed.coalesce(1).collect()] == sorted(order.values()) or spark.read.parquet(str(tmp_path / "b/responses")).rdd.getNumPartitions() > 1
    ran.clear()
    assert S.run_task(jobs, str(tmp_path / "b"), "m", "t", answer, size=5).count() == 53 and not ran  # complete: only read
    assert {r.item_id: r.place for r in S.chunked(jobs.orderBy(F.rand(1)).repartition(3), "item_id", 5).collect()} == {k: p for k, (_, p) in order.items()}
    assert S.run_task(jobs.limit(0), str(tmp_path / "c"), "m", "t", answer).count() == 0
    random.seed(0)
