"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import HOT_PART, hot_join, tidied, written


def with_least(links: DataFrame, rows: int) -> DataFrame:
    """links (a, b) with least, the smallest of a and its b. Minima are combined before the shuffle; hot nodes are broadcast."""
    by = links.groupBy("a").agg(F.least("a", F.min("b")).alias("least"), (F.count("*") * HOT_PART >= rows).alias("hot"))
    return hot_join(links, by, ["a"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node that links reach.

    Alternates large stars and small stars, each an aggregate of a node's links joined back to them, until the links
    no longer change. Each round's links are written, so lineage stays short. No row holds a node's neighbours as a
    list and no task all links of a node.
    """
    with tidied(links.sparkSession) as kept:
        links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
        state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        before = state(links)
        for _ in range(most_rounds):
            both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            large = with_least(both, 2 * before[0]).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
            large = written(large, "links")
            small = with_least(large, before[0]).select("a", "b", "least")
            small = small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
            links = written(small.select("e.a", "e.b").filter("a <> b").distinct(), "links")
            now = state(links)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("links still change after the most rounds that are allowed")
        out = links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")))
        kept.append(written(out.distinct(), "components"))
        return kept[0]
