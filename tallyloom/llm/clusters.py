"""Centroid clustering of integer vectors with JVM expressions.

Vectors become arrays of whole numbers once, in a table. In each round the centroids are literal arrays of the plan:
zip_with and aggregate sum the squared differences, array_min over structs of (distance, number) chooses the cluster,
and a sum for every component, with partial sums in each task, moves the centroids. Only sums, k rows of as many
numbers as there are dimensions, come to the driver. Whole numbers make every result exact, whatever the order of sums.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import narrowed, tidied, written

#: Components beyond this could overflow a squared distance of 64 of them; a vector that has one stops the query.
LARGEST = 1 << 27


def whole_vectors(rows: DataFrame, dimensions: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and v, floor(scale * component), of the vectors with exactly so many components, all finite numbers."""
    rows = narrowed(rows, vec_id=vec_id, v=vector).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.when(F.abs(x) * scale < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component lies beyond {LARGEST} / {scale}")).cast("long"))
    return rows.filter((F.size("v") == dimensions) & F.coalesce(finite, F.lit(False))).withColumn("v", F.transform("v", whole))


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the k smallest hashes of salt and id, in the hashes' order; null ids come last."""
    code = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(code.asc_nulls_last(), "v").select("v").limit(k).collect()]  # k rows


def nearest(centroids: list[list[int]], vector: str = "v") -> Column:
    """struct(distance, cluster) of the nearest centroid by squared distance; of equal ones the first."""
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")
    squared = lambda c: F.aggregate(F.zip_with(vector, c, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, d: s + d)
    return F.array_min(F.transform(table, lambda c, i: F.struct(squared(c).alias("distance"), i.alias("cluster"))))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: exact floors of their vectors' means; one without vectors stays."""
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centroids[0]))]
    rows = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "v").groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect()  # k rows at most
    new = {r["cluster"]: [s // r["n"] for s in r[2:]] for r in rows}
    return [new.get(i, c) for i, c in enumerate(centroids)]


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2:", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    Null vectors, such with another number of components, and such with a null, NaN or infinite one are left out; other
    columns are not read. Repeated rows are vectors of their own and count each time. Rows with a null id take part, but
    are the last to be seeds. Fewer than k vectors make fewer clusters; an empty table, or one without a vector that is
    kept, gives no rows. Of equally near centroids the one of the smaller number takes the vector; seeds of equal ids
    come in the order of their components. Components of 2**27 / scale and more stop the query with an error, since
    their squares may not fit a long.
    """
    spark = rows.sparkSession
    with tidied(spark) as kept:
        vectors = whole_vectors(rows, dimensions, scale, vec_id, vector)
        width = spark.sparkContext.defaultParallelism
        if vectors.rdd.getNumPartitions() < 2 * width:  # a few large files would be a few long tasks in every round
            vectors = vectors.repartition(2 * width)
        vectors = written(vectors, "vectors")
        centroids = seeds(vectors, k, salt)
        if not centroids:
            kept.append(vectors)
            empty = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
            return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()]).filter(F.lit(False))
        for _ in range(rounds):
            centroids = moved(vectors, centroids)
        near = nearest(centroids)
        kept.append(written(vectors.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"), "assigned"))
        sums = {r["cluster"]: r["s"] for r in kept[0].groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    of_each = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster"))
    inertia = [sums.get(i, 0) for i in range(len(centroids))]
    return kept[0].select(
        "vec_id",
        "cluster",
        "distance",
        of_each(inertia).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"),
        of_each([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]).alias("centroid_sha256"),
    )


def cluster_sql(table: str = "embeddings", k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """DuckDB SQL for the rows of ``cluster``: every vector is compared with every centroid, a CTE for each step."""
    assigned = lambda c: f"""
            SELECT r, vec_id, e, m % 1000 AS k, m // 1000 AS d FROM (
                SELECT r, any_value(vec_id) AS vec_id, any_value(e) AS e,
                       min(1000 * list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (e[i] - c[i]) * (e[i] - c[i])))::BIGINT + k) AS m
                FROM v, {c} GROUP BY r)"""  # noqa: E731
    steps = [f"""
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM {table}
            WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{salt}' || vec_id), e) - 1 AS k, e AS c FROM v ORDER BY k LIMIT {k})"""]
    for i in range(1, rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED ({assigned(f'c{i - 1}')}),
        s{i} AS (SELECT k, i, sum(e[i]) AS s, count(*) AS n FROM a{i}, range(1, {dimensions + 1}) AS x(i) GROUP BY k, i),
        m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM s{i} GROUP BY k),
        c{i} AS MATERIALIZED (SELECT k, coalesce(m.c, o.c) AS c FROM c{i - 1} AS o LEFT JOIN m{i} AS m USING (k))""")
    return f"""
        WITH {','.join(steps)},
        f AS MATERIALIZED ({assigned(f'c{rounds}')}),
        t AS (SELECT k, sum(d)::BIGINT AS s FROM f GROUP BY k)
        SELECT f.vec_id, f.k::INTEGER AS cluster, f.d::BIGINT AS distance, t.s AS cluster_inertia, (SELECT sum(s) FROM t)::BIGINT AS inertia,
               sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM f JOIN t USING (k) JOIN c{rounds} AS c USING (k)
    """
