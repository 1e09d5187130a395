"""URL rules by host-suffix and path-prefix expressions.

Each URL is expanded into its host suffixes times the path prefixes whose lengths occur among the rules. The first
four bytes of an expression's SHA-256 are the join key; the full digest then confirms the match and the longest
rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import HOT_PART, hot_join, narrowed, small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and what follows each of its dots."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the url's path starts with
    the rule's; the longest (host and path together) wins, then the longer host, then block before allow. Without a
    fitting rule the verdict is ``default`` and rule is null. Null urls, urls without ``://`` and empty ones have an
    empty host and path, which a rule never fits; empty tables, repeated pages and repeated rules are fine.
    Of a very long url the beginnings of the path that are as long as some rule's are looked up: no other can fit.
    """
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")
    ).filter("rule_host <> ''")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256))
    rules = rules.withColumn("short", F.substring("digest", 1, 8))
    lengths = [r[0] for r in rules.select(F.length("rule_path")).distinct().collect()]  # at most the length of the longest rule
    n_rules = rules.count()

    keyed = narrowed(pages, page_id=page_id, url=url).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return keyed.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # urls that share host and leading path are matched once, whatever their number
    longest = max(lengths)
    keyed = keyed.withColumn("head", F.substring("path", 1, longest))
    heads = written(keyed.groupBy("host", "head").agg(F.count("*").alias("n")), "heads")
    prefixes = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: F.substring(F.col("head"), F.lit(1), n)))
    expressions = heads.filter("host <> ''").select("host", "head", F.explode(suffixes(F.col("host"))).alias("suffix"), prefixes.alias("prefixes"))
    expressions = expressions.select("host", "head", "suffix", F.explode("prefixes").alias("prefix"))
    expressions = expressions.withColumn("full", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)).withColumn("short", F.substring("full", 1, 8))
    hits = expressions.join(small(rules, n_rules), "short").filter(F.col("full") == F.col("digest"))
    size, name = F.length("rule_host") + F.length("rule_path"), F.concat("rule_host", "rule_path")
    best = F.max(F.struct(size.alias("size"), F.length("rule_host").alias("host_size"), F.col("rule_verdict").alias("verdict"), name.alias("rule")))
    best = hits.groupBy("host", "head").agg(best.alias("best"))
    # every url has its head in the table, also where no rule fits, so a frequent one is met by a broadcast in either case
    hot = F.col("n") * HOT_PART >= (heads.agg(F.sum("n")).first()[0] or 0)
    told = heads.join(best, ["host", "head"], "left").select("host", "head", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), hot.alias("hot"))
    return hot_join(keyed, written(told, "told"), ["host", "head"]).select("page_id", "host", "path", "rule", "verdict")
