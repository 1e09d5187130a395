"""How the operators are bound to the given tables, in DataFrames and, for the oracle, in SQL."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators.ranges import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: What the query that a thread declares has made so far.
_declared = threading.local()


def once(key, make):
    """What make gives, the same for all uses in the declaration of one query."""
    made = getattr(_declared, "made", {})
    if key not in made:
        made[key] = make()
    return made[key]


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under name, with the SQL that gives the same rows."""

    def keep(f):
        @wraps(f)
        def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
            _declared.made = {}
            return f(spark, sf_dir)

        QUERIES[name] = declared
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, rn (place in the label by vec_id) and v, the normalised embedding."""
    rows = numbered(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), ["label"], "vec_id", "rn")
    return rows.select("vec_id", "label", "rn", V.normalised(F.col("embedding")).alias("v"))


#: The same rows in SQL: p has vectors, l one row per entry (i from 0).
P = """p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS rn,
      list_transform(c, lambda x: CASE WHEN s > 0 THEN x / s ELSE 1.0::DOUBLE / len(c) END) AS v
    FROM (SELECT vec_id, label, c, list_sum(c) AS s FROM (SELECT vec_id, label, list_transform(embedding, lambda x: greatest(x::DOUBLE, 0)) AS c FROM embeddings))),
  l AS (SELECT vec_id, label, rn, unnest(v) AS x, unnest(range(len(v)))::INT AS i FROM p)"""



def cased(size: int) -> str:
    """P with a run of ``size`` places as label (the label and the run's number) and the place in the run as rn, as runs does."""
    own = P.replace("p AS (", "p0 AS (", 1).split(",\n  l AS")[0]
    run = f"p AS (SELECT vec_id, label::VARCHAR || '|' || ((rn - 1) // {size}) AS label, label AS target, ((rn - 1) % {size} + 1)::INT AS rn, v FROM p0)"
    return own + ",\n  " + run + ",\n  l AS (SELECT vec_id, label, target, rn, unnest(v) AS x, unnest(range(len(v)))::INT AS i FROM p)"


P20, P12 = cased(20), cased(12)

#: Arms of a case by place: ten permutations, six retests, two canonical, two shuffled.
ARMS = [("permutation", 1, 10), ("retest", 11, 16), ("canonical", 17, 18), ("shuffled", 19, 20)]
ARM_SQL = "CASE " + " ".join(f"WHEN rn BETWEEN {a} AND {b} THEN '{k}'" for k, a, b in ARMS) + " END"


def runs(rows: DataFrame, size: int) -> DataFrame:
    """rows with case_id, the label and the number of its run of ``size`` places, and rn from 1 in the run: no row is left out."""
    return rows.withColumn("case_id", F.concat_ws("|", "label", F.expr(f"(rn - 1) div {size}"))).withColumn("rn", (F.col("rn") - 1) % size + 1)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id (label and run of 20 places), vec_id, arm, idx (from 0 in the arm) and v, of all embeddings."""
    p = runs(posteriors(spark, sf_dir), 20)
    first = F.expr("CASE " + " ".join(f"WHEN rn BETWEEN {a} AND {b} THEN {a}" for _, a, b in ARMS) + " END")
    return p.select("case_id", "vec_id", F.expr(ARM_SQL).alias("arm"), (F.col("rn") - first).alias("idx"), "v")


#: term of the Jensen-Shannon divergence of entries x and y
JSD_TERM = """CASE WHEN {x} > 1e-12 THEN {x} * log2({x} / greatest(({x} + {y}) / 2, 1e-12)) / 2 ELSE 0 END + CASE WHEN {y} > 1e-12 THEN {y} * log2({y} / greatest(({x} + {y}) / 2, 1e-12)) / 2 ELSE 0 END"""
JSD = "least(1, greatest(0, sum(" + JSD_TERM.format(x="a.x", y="b.x") + ")))"
RESP = P20 + f""", r AS (SELECT label AS case_id, vec_id, {ARM_SQL} AS arm, rn FROM p WHERE rn <= 20),
  pr AS (SELECT a.label AS case_id, a.vec_id AS a_id, b.vec_id AS b_id, a.rn AS a_rn, b.rn AS b_rn, {JSD} AS jsd
         FROM l a JOIN l b ON a.label = b.label AND a.i = b.i AND a.rn < b.rn AND b.rn <= 20 GROUP BY ALL),
  pa AS (SELECT *, {ARM_SQL.replace("rn", "a_rn")} AS a_arm, {ARM_SQL.replace("rn", "b_rn")} AS b_arm FROM pr)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order a row: row_id, label (priority), sex (status), split (year), age (days mod 100), tokens (its distinct brands)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tokens = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("p_brand")).alias("tokens"))
    return table(spark, sf_dir, "orders").join(tokens, "o_orderkey").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("sex"), F.year("o_orderdate").alias("split"),
        (F.col("o_custkey") % 100).cast("int").alias("age"), "tokens",
    )


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", "label", F.explode("tokens").alias("token"))


C = """t AS (SELECT DISTINCT o_orderkey AS row_id, o_orderpriority AS label, p_brand AS token
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
  c AS (SELECT o_orderkey AS row_id, o_orderpriority AS label, o_orderstatus AS sex, year(o_orderdate)::INT AS split, (o_custkey % 100)::INT AS age FROM orders
      WHERE o_orderkey IN (SELECT row_id FROM t))"""
