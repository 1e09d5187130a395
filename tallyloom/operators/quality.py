"""Checks of a corpus, each as a table: nulls, duplicates, quantiles, drift, replicates, coverage, balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.ranges import placed


def null_counts(df: DataFrame) -> DataFrame:
    """column, its nulls and its empties (lists or texts without an entry), in one pass."""
    nothing = lambda c, t: F.count_if(F.size(c) == 0) if t.startswith("array") else F.count_if(F.length(c) == 0) if t == "string" else F.lit(0).cast("long")
    row = df.agg(*[x for c, t in df.dtypes for x in (F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), nothing(c, t).alias(f"{c}__empty"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__empty").alias("empty")) for c in df.columns])).alias("z")).select("z.*")


def duplicates(df: DataFrame, key: Column, split: Column) -> DataFrame:
    """One row: rows, distinct keys, rows beyond the first of their key, keys in several splits and rows that hold them."""
    keys = df.select(key.alias("k"), split.alias("s")).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("s").alias("splits"))
    return keys.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_beyond"), F.count_if(F.col("splits") > 1).alias("keys_across"), F.sum(F.when(F.col("splits") > 1, F.col("n")).otherwise(0)).alias("rows_across")
    )


def replicate_pairs(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """One row: pairs inside groups of equal keys and how many differ in value, from counts and without making pairs."""
    cells = df.groupBy(*key, value).agg(F.count("*").alias("n"))
    groups = cells.groupBy(*key).agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"))
    pairs = F.expr("n * (n - 1) div 2")
    return groups.agg(F.sum(pairs).alias("n_pairs"), F.sum(pairs - F.col("same")).alias("n_differ"))


def vector_pairs(rows: DataFrame, key: list[str], value: str | Column = "v") -> DataFrame:
    """a, b and times: the pairs of vectors inside groups of equal keys, equal pairs once with their number. value: the
    vector, which is made only where a group has several rows.

    Rows that are alone in their group are dropped by their keys first. Equal vectors of a group are counted before they
    meet, so a group costs the square of its different vectors.
    """
    several = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(*key)
    made = F.col(value) if isinstance(value, str) else value
    cells = rows.join(several, key, "left_semi").select(*key, made.alias("v")).groupBy(*key, "v").agg(F.count("*").alias("n"))
    side = lambda k: cells.select(*key, F.col("v").alias(k), F.col("n").alias(f"n_{k}"))
    apart = side("a").join(side("b"), key).filter("a < b").select("a", "b", (F.col("n_a") * F.col("n_b")).alias("times"))
    same = cells.filter("n > 1").select(F.col("v").alias("a"), F.col("v").alias("b"), F.expr("n * (n - 1) div 2").alias("times"))
    return apart.unionByName(same)


def replicate_noise(rows: DataFrame, key: list[str] | None = None, value: str | Column = "v") -> DataFrame:
    """One row, mean_jsd over the pairs of equal keys, case_id if none are given."""
    from tallyloom.functions.vectors import jsd

    pairs = vector_pairs(rows, key or ["case_id"], value)
    return pairs.agg((F.sum(jsd(F.col("a"), F.col("b")) * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("mean_jsd"))


def stability_index(df: DataFrame, split: Column, category: Column, base: str) -> DataFrame:
    """split and the population stability index of its categories against the base split."""
    cells = df.select(split.cast("string").alias("split"), category.alias("category")).groupBy("split", "category").agg(F.count("*").alias("n"))
    grid = cells.select("split").distinct().crossJoin(cells.select("category").distinct()).join(cells, ["split", "category"], "left").fillna(0, ["n"])
    share = grid.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("split")) + 1e-9)
    own = share.filter(F.col("split") == base).select("category", F.col("p").alias("a"))
    return share.filter(F.col("split") != base).join(own, "category").groupBy("split").agg(F.sum((F.col("p") - F.col("a")) * F.ln(F.col("p") / F.col("a"))).alias("psi"))


def balance(df: DataFrame, label: str) -> DataFrame:
    """label, n, share, entropy of the shares in bits, and the ratio of the largest to the smallest class, on every row."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    tot = n.agg(F.sum("n").alias("all"), (F.max("n") / F.min("n")).alias("imbalance"), (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))
    return n.crossJoin(F.broadcast(tot)).select(label, "n", (F.col("n") / F.col("all")).alias("share"), "imbalance", "entropy")  # one row


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], times: str | None = None) -> DataFrame:
    """by and a column for each of at (name: share): the group's exact quantile, interpolated between two places. times: see placed."""
    cells = placed(df, by, value, times)
    here = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("value").cast("double")))
    h = lambda q: (F.col("all") - 1) * F.lit(q)
    # products like 0.07 * 100 that miss a whole number by an ulp are taken as that number
    low = lambda q: F.floor(h(q) + 1e-9)
    wanted = [x for k, q in at.items() for x in (here(low(q)).alias(f"{k}_a"), here(F.least(low(q) + 1, F.col("all") - 1)).alias(f"{k}_b"), F.max(F.greatest(h(q) - low(q), F.lit(0.0))).alias(f"{k}_f"))]
    out = cells.groupBy(*by).agg(*wanted)
    return out.select(*by, *[(F.col(f"{k}_a") + (F.col(f"{k}_b") - F.col(f"{k}_a")) * F.col(f"{k}_f")).alias(k) for k in at])


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """by, the value and name, its average rank (from 1) in its group."""
    return placed(df, by, value).select(*by, F.col("value").alias(value), (F.col("before") + (F.col("n") + 1) / 2).alias(name))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by and the rank correlation of two columns, equal values at their average rank. Rows with a null are left out.

    Rows that agree in both columns are one with a count before they meet their ranks.
    """
    rows = df.select(*by, x, y).dropna(subset=[x, y])
    cells = rows.groupBy(*by, x, y).agg(F.count("*").cast("double").alias("__n"))
    cells = cells.join(average_ranks(rows, by, x, "__x"), [*by, x]).join(average_ranks(rows, by, y, "__y"), [*by, y])
    n, a, b = F.col("__n"), F.col("__x"), F.col("__y")
    sums = cells.groupBy(*by).agg(F.sum(n).alias("n"), *[F.sum(n * c).alias(k) for k, c in (("a", a), ("b", b), ("ab", a * b), ("aa", a * a), ("bb", b * b))])
    part = lambda k, i, j: F.col(k) / F.col("n") - F.col(i) / F.col("n") * F.col(j) / F.col("n")
    return sums.select(*by, (part("ab", "a", "b") / F.nullif(F.sqrt(part("aa", "a", "a") * part("bb", "b", "b")), F.lit(0.0))).alias("spearman"))


def outliers(df: DataFrame, value: str) -> DataFrame:
    """One row: quartiles, Tukey's upper fence and the rows above it."""
    q = quantiles(df, [], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return df.crossJoin(F.broadcast(q)).groupBy("q1", "median", "q3", "fence").agg(F.count_if(F.col(value) > F.col("fence")).alias("n_above"))  # one row


def nearest_rank(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The value at the nearest place to ``share`` of a group's sorted values, and the group's rows."""
    place = F.round(share * (F.col("all") - 1)).cast("long")
    return placed(df, by, value).filter((F.col("before") <= place) & (place < F.col("before") + F.col("n"))).select(*by, "value", F.col("all").alias("n"))


def screened(df: DataFrame, text: str, screens: dict[str, list[str]]) -> DataFrame:
    """screen and the columns of df, a row for every screen of which some part of a word occurs in the text, in either case."""
    held = lambda parts: reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(text)), F.lit(p.lower())) for p in parts], F.lit(False))
    found = F.array_compact(F.array(*[F.when(held(parts), F.lit(name)) for name, parts in screens.items()]))
    return df.select(F.explode(found).alias("screen"), *df.columns)


def accuracy(rows: DataFrame, by: list[str], truth: str, predicted: str, z: float = 1.96) -> DataFrame:
    """Per group: answers, accuracy with its interval, ratio to chance, largest share of one answer, entropy of answers."""
    from tallyloom.operators.conditioning import wilson

    got = rows.filter(F.col(predicted).isNotNull())
    base = got.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"), F.count_distinct(truth).alias("classes"))
    share = got.groupBy(*by, predicted).agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))
    spread = share.groupBy(*by).agg(F.max("p").alias("top_share"), F.sum(-F.col("p") * F.log2("p")).alias("answer_entropy"))
    low, high = wilson(F.col("accuracy"), F.col("n"), z)
    return base.join(spread, by).select(*by, "n", "accuracy", low.alias("low"), high.alias("high"), (F.col("accuracy") * F.col("classes")).alias("to_chance"), "top_share", "answer_entropy")


def mcnemar(rows: DataFrame, first: str, second: str) -> DataFrame:
    """One row: discordant counts of two boolean columns and the continuity-corrected statistic."""
    n = rows.agg(F.count_if(F.col(first) & ~F.col(second)).alias("only_first"), F.count_if(~F.col(first) & F.col(second)).alias("only_second"))
    b, c = F.col("only_first"), F.col("only_second")
    return n.withColumn("chi_squared", F.when(b + c > 0, (F.abs(b - c) - 1) * (F.abs(b - c) - 1) / (b + c)))
