"""Items of a battery: arms of a case, updates, redundant tokens and distractors, from hash orders of a case's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import conditioning as K, sampling as S
from tallyloom.operators.kept import kept
from tallyloom.operators.ranges import upto


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the SHA-1 of the parts."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Groups of tokens whose counts one window sums, and stretches of the pool that draws and tokens meet in.
GROUPS, STRETCHES = 3, 1 << 16


def pool(tokens: DataFrame) -> DataFrame:
    """token, low, high and all: each token's places in the pool of all occurrences, low to high - 1 of all of them.

    Tokens come by the first hexadecimal digits of their hashes and then by themselves, so that a window holds a group
    of them, and another one the 16 ** GROUPS groups.
    """
    n = tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("group", F.substring(F.sha1(F.col("token").cast("binary")), 1, GROUPS))
    groups = n.groupBy("group").agg(F.sum("n").alias("n")).select("group", upto("n", [], "group").alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    low = F.col("base") + F.col("inner")
    return n.withColumn("inner", upto("n", ["group"], "token")).join(groups, "group").select("token", low.alias("low"), (low + F.col("n")).alias("high"), "all")


def drawn_places(cases: DataFrame, total: DataFrame, key: str, draws: int) -> DataFrame:
    """key, perm_index and places: for each replicate as many places of the pool as the case has tokens, none twice.

    Places are hashes of case, replicate and attempt; repeats are rejected. What 2 n + 16 attempts leave open, which
    happens only where the pool is hardly larger than n, is filled with the smallest free places. total: one row, all.
    """
    size = F.size("tokens")
    place = lambda i: F.conv(F.substring(F.sha1(F.concat_ws("|", F.lit("x"), F.col(key).cast("string"), F.col("perm_index").cast("string"), i.cast("string"))), 1, 13), 16, 10).cast("long") % F.col("all")
    tried = F.concat(F.transform(F.sequence(F.lit(0), 2 * size + 15), place), F.sequence(F.lit(0).cast("long"), (size - 1).cast("long")))
    rows = cases.filter(size > 0).select(key, "tokens").crossJoin(F.broadcast(total)).withColumn("perm_index", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))  # one row
    first = F.array(F.transform(F.sequence(F.lit(0), size - 1), place))
    told = F.transform(first, lambda p: F.when(F.size(F.array_distinct(p)) == size, p).otherwise(F.slice(F.array_distinct(tried), F.lit(1), size)))  # further attempts only after a repeat
    return rows.select(key, "perm_index", F.get(told, F.lit(0)).alias("places"))


def pooled(cases: DataFrame, tokens: DataFrame, key: str, draws: int) -> DataFrame:
    """key, perm_index and evidence_order: as many tokens as the case has, drawn without replacement from all occurrences
    of all cases; a token may come as often as it occurs.

    Places meet the tokens that hold them by stretches of the pool, a range join on equal numbers.
    """
    table = pool(tokens)
    width = F.greatest(F.lit(1).cast("long"), F.expr(f"all div {STRETCHES}"))
    held = table.withColumn("width", width).select("token", "low", "high", F.explode(F.sequence(F.expr("low div width"), F.expr("(high - 1) div width"))).alias("stretch"))
    total = tokens.agg(F.count("*").alias("all"))
    places = drawn_places(cases, total, key, draws).select(key, "perm_index", F.posexplode("places").alias("slot", "place")).crossJoin(F.broadcast(total.select(width.alias("width"))))  # one row
    found = places.withColumn("stretch", F.expr("place div width")).join(held, "stretch").filter((F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    order = F.array_sort(F.collect_list(F.struct("slot", "token")))  # the tokens of an item
    return found.groupBy(key, "perm_index").agg(F.transform(order, lambda z: z["token"]).alias("evidence_order"))


def arms(cases: DataFrame, tokens: DataFrame, key: str, permutations: int = 10, retests: int = 6, canonical: int = 2, shuffled: int = 2) -> DataFrame:
    """key, arm, perm_index, replicate and evidence_order of every item.

    Permutations are distinct and never the canonical order; a case without any keeps its canonical order as one. Retests
    repeat the first permutation, canonical items the given order; shuffled ones draw from all cases' tokens without replacement.
    """
    alone = F.when(F.size("orders") > 0, F.col("orders")).otherwise(F.array("canonical"))
    own = S.orders(cases, key, "tokens", permutations).select(key, "canonical", F.explode(F.array(alone)).alias("orders"))  # one row, so that the orders are made once
    again = [("retest", r, F.get("orders", F.lit(0))) for r in range(retests)] + [("canonical", r, F.col("canonical")) for r in range(canonical)]
    return laid_out(own, key, F.transform("orders", lambda o, j: item("permutation", j, F.lit(0), o)), again).unionByName(drawn(cases, tokens, key, shuffled))


def item(arm: str, index: Column, replicate: Column, order: Column) -> Column:
    return F.struct(F.lit(arm).alias("arm"), index.cast("int").alias("perm_index"), replicate.cast("int").alias("replicate"), order.alias("evidence_order"))


def laid_out(own: DataFrame, key: str, made: Column, again: list[tuple[str, int, Column]]) -> DataFrame:
    """A row for every item of made (an array of item) and of again (arm, replicate, order): a case is not shuffled."""
    return own.select(key, F.inline(F.concat(made, *[F.array(item(arm, F.lit(0), F.lit(r), order)) for arm, r, order in again])))


def drawn(cases: DataFrame, tokens: DataFrame, key: str, draws: int) -> DataFrame:
    """The shuffled arm."""
    return pooled(cases, tokens, key, draws).select(key, F.lit("shuffled").alias("arm"), F.col("perm_index").cast("int").alias("perm_index"), F.col("perm_index").cast("int").alias("replicate"), "evidence_order")


def narrated(cases: DataFrame, tokens: DataFrame, key: str, permutations: int = 8, retests: int = 4, shuffled: int = 2) -> DataFrame:
    """The arms of notes: permutation 0 is the given order, which the retests repeat; there is no canonical arm."""
    own = S.orders(cases, key, "tokens", permutations - 1)
    given = [("permutation", 0, F.col("canonical"))] + [("retest", r, F.col("canonical")) for r in range(retests)]
    return laid_out(own, key, F.transform("orders", lambda o, j: item("permutation", j + 1, F.lit(0), o)), given).unionByName(drawn(cases, tokens, key, shuffled))


def drawn_contexts(tokens: DataFrame, sizes: list[int], key: str = "row_id") -> DataFrame:
    """key, context (sorted) and new: the first tokens of a row in hash order and the one after them; how many a hash of
    the row picks from sizes. Rows with too few tokens have none."""
    t = tokens.select(key, "token").distinct()
    ordered = t.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.md5(F.concat_ws("|", key, "token")).alias("h"), "token"))), lambda z: z["token"]).alias("ts"))
    k = F.get(F.array(*[F.lit(s) for s in sizes]), F.floor(uniform(F.lit("k"), F.col(key)) * len(sizes)).cast("int"))
    rows = ordered.withColumn("k", k).filter(F.size("ts") > F.col("k"))
    return rows.select(key, F.array_sort(F.slice("ts", F.lit(1), F.col("k"))).alias("context"), F.get("ts", F.col("k")).alias("new"))


def update_items(tokens: DataFrame, rows: DataFrame, sizes: list[int], least_support: int) -> DataFrame:
    """item_id, context, new, label, n and support before and after, p before and after, and delta of the log-odds.

    Equal (context, new) of several rows are one item; items with less support on either side are dropped.
    """
    items = kept(drawn_contexts(tokens, sizes).select("context", "new").distinct())
    items = items.withColumn("before_id", F.array_join("context", "|")).withColumn("item_id", F.concat_ws(">", "before_id", "new"))
    contexts = items.select(F.col("before_id").alias("item_id"), F.col("context").alias("evidence")).distinct()
    both = items.select("item_id", F.concat("context", F.array("new")).alias("evidence"))
    side = lambda df, k: df.filter(F.col("support") >= least_support).select(F.col("item_id").alias("id"), "label", *[F.col(c).alias(f"{c}_{k}") for c in ("n", "support", "p")])
    before, after = side(K.conditioned(contexts, tokens, rows), "before"), side(K.conditioned(both, tokens, rows), "after")
    out = items.join(before.withColumnRenamed("id", "before_id"), "before_id").join(after.withColumnRenamed("id", "item_id"), ["item_id", "label"])
    return out.drop("before_id").withColumn("delta", K.log_odds(F.col("p_after")) - K.log_odds(F.col("p_before")))


def redundancy_items(tokens: DataFrame, rows: DataFrame, sizes: list[int], least_support: int, most_jsd: float, each: int = 3) -> DataFrame:
    """context, token, support and jsd: up to ``each`` tokens that move the posterior of a drawn context by most_jsd or less."""
    contexts = drawn_contexts(tokens, sizes).select("context").distinct().select(F.array_join("context", "|").alias("item_id"), F.col("context").alias("evidence"))
    return K.redundancy(contexts, tokens, rows, least_support, each, most_jsd).withColumnRenamed("item_id", "context")


def distractors(cases: DataFrame, tokens: DataFrame, rows: DataFrame, ratios: DataFrame, first: int, least_support: int, most_jsd: float, key: str = "row_id") -> DataFrame:
    """key and token: of the tokens that are redundant to a case's first ones and not its own, that with the largest
    absolute log ratio for some label; of equal ones (to nine digits) the smallest. Cases without any have no row."""
    own = cases.filter(F.size("tokens") >= first).select(key, "tokens", F.slice("tokens", 1, first).alias("evidence")).withColumn("item_id", F.array_join("evidence", "|"))
    found = K.redundancy(own.select("item_id", "evidence").distinct(), tokens, rows, least_support, 40, most_jsd)
    salience = ratios.groupBy("token").agg(F.round(F.max(F.abs("log_ratio")), 9).alias("salience"))
    offered = own.join(found.select("item_id", "token").join(salience, "token"), "item_id").filter(~F.array_contains("tokens", F.col("token")))
    return offered.groupBy(key).agg(F.min(F.struct((-F.col("salience")).alias("s"), "token"))["token"].alias("token"))
