"""Posteriors conditioned on sets of evidence, likelihoods, log ratios and their fusion, over long (row, token) tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import support as P

#: The z of a 95 % interval in vectors and in scalars, bounds of probabilities, of log ratios, of likelihoods.
Z_VECTOR, Z_SCALAR, P_FLOOR, RATIO_BOUND, LOSS_FLOOR = 1.959963984540054, 1.96, 1e-6, 7.0, 1e-12


def prior(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n and its share."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select(label, "n", (F.col("n") / F.col("all")).alias("p"))  # one row


def known_evidence(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """(item_id, token): the distinct tokens of each item that some row has."""
    wanted = items.select("item_id", F.explode(F.array_distinct("evidence")).alias("token"))
    return wanted.join(tokens.select("token").distinct(), "token")


def bound_items(items: DataFrame, tokens: DataFrame) -> DataFrame:
    """item_id and evidence, cut down to the tokens that some row has, of the items that have any."""
    return known_evidence(items, tokens).groupBy("item_id").agg(F.collect_set("token").alias("evidence"))  # an item's tokens


def matches(items: DataFrame, tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """(item_id, row_id, label) of the rows that hold all known tokens of an item.

    items: item_id and evidence (array). An item meets the rows of its rarest token, and its other tokens are looked up
    in the row. Tokens that no row has are left out of the evidence; an item without any then matches every row. What
    only counts rows takes supports or conditioned, which never write these pairs.
    """
    wanted = known_evidence(items, tokens)
    held = tokens.groupBy("row_id", "label").agg(F.collect_set("token").alias("held"))  # the tokens of a row
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"))
    rare = wanted.join(counts, "token").groupBy("item_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"), F.collect_set("token").alias("need"))
    met = held.select("row_id", "label", "held", F.explode("held").alias("token")).join(rare, "token")
    found = met.filter(F.size(F.array_except("need", "held")) == 0).select("item_id", "row_id", "label")
    free = items.join(wanted.select("item_id").distinct(), "item_id", "left_anti").select("item_id")
    return found.unionByName(free.join(rows.select("row_id", "label")).select("item_id", "row_id", "label"))


def supports(items: DataFrame, tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id and support, the number of rows that matches gives for an item, where there are any."""
    return conditioned(items, tokens, rows).groupBy("item_id").agg(F.max("support").alias("support")).filter("support > 0")


def conditioned(items: DataFrame, tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id, label, n, support and p for every label; uniform where an item has no support.

    An item without a known token has the labels' own counts. rows: row_id, label and, if at hand, tokens, the arrays that
    the table of tokens was made from.
    """
    axis = rows.groupBy("label").agg(F.count("*").alias("n_d"))
    own = bound_items(items, tokens)
    counts = P.counts(own, tokens, rows)
    bound = own.select("item_id", F.lit(True).alias("bound"))
    full = items.select("item_id").join(bound, "item_id", "left").crossJoin(F.broadcast(axis))  # the labels
    full = full.join(counts, ["item_id", "label"], "left").withColumn("n", F.when(F.col("bound"), F.coalesce("n", F.lit(0))).otherwise(F.col("n_d")))
    by = Window.partitionBy("item_id")
    full = full.withColumn("support", F.sum("n").over(by)).withColumn("size", F.count("*").over(by))
    return full.select("item_id", "label", "n", "support", F.when(F.col("support") > 0, F.col("n") / F.col("support")).otherwise(1.0 / F.col("size")).alias("p"))


def wide_conditioned(items: DataFrame, tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id, support and p, the shares of the labels in order, of the items that some row holds. rows: see conditioned."""
    counts = P.counts(items, tokens, rows).groupBy("item_id").agg(F.sum("n").alias("support"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("own"))  # the labels
    share = F.transform("axis", lambda k: F.coalesce(F.try_element_at("own", k), F.lit(0).cast("long")) / F.col("support"))
    axis = rows.agg(F.array_sort(F.collect_set("label")).alias("axis"))
    return counts.crossJoin(F.broadcast(axis)).select("item_id", "support", share.alias("p"))  # one row


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1)))


def wilson(p: Column, n: Column, z: float = Z_VECTOR) -> tuple[Column, Column]:
    """Lower and upper end, held to [0, 1]; null without rows."""
    m = F.when(n > 0, n.cast("double"))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def log_odds(p: Column, floor: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.ln(q / (1 - q))


def likelihoods(tokens: DataFrame, rows: DataFrame, smooth: float = 0.5) -> DataFrame:
    """label, token, n_de, n_d, p and log_prior for every label and token; occurrences count, also repeated ones."""
    labels = rows.groupBy("label").agg(F.count("*").alias("n_d"))
    labels = labels.agg(F.collect_list(F.struct("label", "n_d")).alias("labels"), F.sum("n_d").alias("all"))  # one row: the labels
    seen = tokens.groupBy("label", "token").agg(F.count("*").alias("n_de"))
    own = seen.groupBy("token").agg(F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n_de")))).alias("own"))  # a token's labels
    grid = own.crossJoin(F.broadcast(labels)).select("token", "own", "all", F.explode("labels").alias("d"))  # smoothing makes every cell count
    out = grid.select(F.col("d.label").alias("label"), "token", F.coalesce(F.try_element_at("own", "d.label"), F.lit(0).cast("long")).alias("n_de"), F.col("d.n_d").alias("n_d"), "all")
    return out.select("label", "token", "n_de", "n_d", ((F.col("n_de") + smooth) / (F.col("n_d") + 2 * smooth)).alias("p"), F.ln(F.col("n_d") / F.col("all")).alias("log_prior"))


def mixture_ratio(table: DataFrame) -> DataFrame:
    """table with log_ratio: of p to the other labels' mixture by prior."""
    by = Window.partitionBy("token")
    pr = F.exp("log_prior")
    other = (F.sum(F.col("p") * pr).over(by) - F.col("p") * pr) / F.greatest(1 - pr, F.lit(1e-12))
    clip = lambda c: F.least(F.greatest(c, F.lit(P_FLOOR)), F.lit(1 - P_FLOOR))
    return table.withColumn("log_ratio", F.ln(clip(F.col("p"))) - F.ln(clip(other)))


def count_ratio(tokens: DataFrame, rows: DataFrame, smooth: float = 0.5) -> DataFrame:
    """label, token and log_ratio from counts inside and outside a label."""
    t = likelihoods(tokens, rows, smooth)
    by, over = Window.partitionBy("token"), Window.partitionBy("token")
    other = (F.sum("n_de").over(by) - F.col("n_de") + smooth) / (F.sum("n_d").over(over) - F.col("n_d") + 2 * smooth)
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return t.select("label", "token", (F.ln(clip(F.col("p"))) - F.ln(clip(other))).alias("log_ratio"))


def share_of(score: str, by: list[str]) -> Column:
    """Softmax of a long column of scores over a group, shifted by its largest."""
    w = Window.partitionBy(*by)
    top = F.max(score).over(w)
    return F.exp(F.col(score) - top) / F.sum(F.exp(F.col(score) - F.max(score).over(w))).over(w)


def naive_bayes(cases: DataFrame, table: DataFrame, absences: bool = False) -> DataFrame:
    """row_id, label, p: log prior and the logs of the likelihoods of a case's tokens, and of what it lacks if asked."""
    gain = F.ln("p") - F.ln(1 - F.col("p")) if absences else F.ln("p")
    present = cases.join(table.select("label", "token", gain.alias("g")), "token").groupBy("row_id", "label").agg(F.sum("g").alias("g"))
    base = table.groupBy("label").agg(F.max("log_prior").alias("base"), F.sum(F.ln(1 - F.col("p"))).alias("none"))
    scores = present.join(base, "label").withColumn("score", F.col("g") + F.col("base") + (F.col("none") if absences else F.lit(0.0)))
    return scores.select("row_id", "label", share_of("score", ["row_id"]).alias("p"))


def wide_bayes(cases: DataFrame, table: DataFrame) -> DataFrame:
    """row_id and p, the shares of naive_bayes without absences as an array over the labels in order."""
    from tallyloom.functions.vectors import softmax

    base = table.groupBy("label").agg(F.max("log_prior").alias("base")).agg(in_order(F.col("base")).alias("base"))
    sums = wide_sums(cases, table, value=F.ln("p")).crossJoin(F.broadcast(base))  # one row
    scores = F.array(F.zip_with("s", "base", lambda a, b: a + b))
    return sums.select("row_id", F.get(F.transform(scores, softmax), F.lit(0)).alias("p"))


def evidence_sums(cases: DataFrame, weights: DataFrame) -> DataFrame:
    """row_id, label, s: sums of bounded log ratios; a token that stands twice adds twice, cases without a known one go."""
    w = weights.select("label", "token", bounded().alias("w"))
    return cases.join(w, "token").groupBy("row_id", "label").agg(F.sum("w").alias("s"))


def fused(sums: DataFrame, priors: DataFrame, scale: float | Column = 1.0) -> DataFrame:
    """row_id, label, p: softmax of log prior and scaled sums."""
    scores = sums.join(priors.select("label", F.ln(F.greatest("p", F.lit(1e-9))).alias("lp")), "label").withColumn("score", F.col("lp") + scale * F.col("s"))
    return scores.select("row_id", "label", share_of("score", ["row_id"]).alias("p"))


#: The scales among which one is fitted, and those of the frontier.
FIT_GRID = [round(0.02 * k, 2) for k in range(1, 26)] + [round(0.55 + 0.05 * k, 2) for k in range(20)]
FRONTIER_GRID = [0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0, 3.0]


def bounded(ratio: str = "log_ratio") -> Column:
    return F.least(F.greatest(ratio, F.lit(-RATIO_BOUND)), F.lit(RATIO_BOUND))


def in_order(value: Column) -> Column:
    """Aggregate: a value of each label as an array, in the order of labels."""
    return F.transform(F.array_sort(F.collect_list(F.struct("label", value.alias("v")))), lambda z: z["v"])


def base_scores(priors: DataFrame) -> DataFrame:
    """One row: axis, the labels in order, and base, the logs of their priors."""
    return priors.agg(F.array_sort(F.collect_list("label")).alias("axis"), in_order(F.ln(F.greatest("p", F.lit(1e-9)))).alias("base"))


def wide_sums(cases: DataFrame, weights: DataFrame, keep: list[str] | None = None, value: Column | None = None) -> DataFrame:
    """row_id, the columns of keep (the same on all rows of a case) and s: the sums of evidence_sums as an array over the
    labels in order, or of value, a column of weights. weights has a row for every label and token; the table of a row per
    token is broadcast. One shuffle of the cases' tokens, none if they are dealt by row_id."""
    keep = keep or []
    by_token = weights.groupBy("token").agg(in_order(bounded() if value is None else value).alias("w"))  # the labels
    own = cases.select("row_id", "token", *keep).join(F.broadcast(by_token), "token").groupBy("row_id", *keep).agg(F.collect_list("w").alias("ws"))  # the tokens of a case
    zero = F.transform(F.get("ws", F.lit(0)), lambda x: F.lit(0.0))
    return own.select("row_id", *keep, F.aggregate("ws", zero, lambda s, w: F.zip_with(s, w, lambda a, b: a + b)).alias("s"))


#: Numbers that a task works on at once.
AT_ONCE = 1 << 21


def case_losses(s: np.ndarray, base: np.ndarray, at: np.ndarray, grid: np.ndarray, top: int) -> np.ndarray:
    """nll, hits at the top and among ``top``, and entropy (bits) of cases (rows of s) at each scale: an array of scales x 4 x cases.

    Of equal scores the earlier label is the higher one.
    """
    z = base + grid[:, None, None] * s[None]
    e = np.exp(z - z.max(-1, keepdims=True))
    p = e / e.sum(-1, keepdims=True)
    own = np.take_along_axis(p, np.broadcast_to(at[None, :, None], (len(grid), len(at), 1)), -1)
    above = ((p > own) | ((p == own) & (np.arange(p.shape[-1]) < at[:, None]))).sum(-1)
    entropy = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(-1)
    return np.stack([-np.log(np.maximum(own[..., 0], LOSS_FLOOR)), above == 0, above < top, entropy], axis=1)


def scale_trace(sums: DataFrame, priors: DataFrame, truth: str, grid: list[float], by: list[str] | None = None, top: int = 5) -> DataFrame:
    """by, tau, n and the means over cases of nll, error, top1, a column named after ``top``, and entropy, at each scale.

    sums: of wide_sums, with the columns truth and by; top: two or more. Cases whose truth is no label are left out. One pass: a case stays
    one row, its scales are laid out in the task, and a row per group and scale leaves it.
    """
    by, types = by or [], dict(sums.dtypes)
    sums = sums.crossJoin(F.broadcast(base_scores(priors)))  # one row
    rows = sums.withColumn("at", F.array_position("axis", F.col(truth)).cast("int") - 1).filter("at >= 0").select(*by, "s", "base", "at")
    kinds = [sums.schema[c].dataType for c in by]
    names = ["nll", "top1", f"top{top}", "entropy"]

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        totals: dict[tuple, np.ndarray] = {}
        scales = np.array(grid)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column("s").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            base, at = np.array(batch.column("base")[0].as_py()), batch.column("at").to_numpy(zero_copy_only=False)
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(*[batch.column(c).to_pylist() for c in by], strict=True) if by else [()] * len(at)):
                groups.setdefault(group, []).append(i)
            most = max(1, AT_ONCE // (len(grid) * s.shape[1]))
            for group, own in groups.items():
                total = totals.setdefault(group, np.zeros((len(grid), 5)))
                for k in range(0, len(own), most):
                    part = own[k : k + most]
                    total[:, 0] += len(part)
                    total[:, 1:] += case_losses(s[part], base, at[part], scales, top).sum(-1)
        for group, total in totals.items():
            own = [pa.array([v] * len(grid), to_arrow_type(t)) for v, t in zip(group, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(scales), *map(pa.array, total.T)], names=[*by, "tau", "n", *names])

    schema = ", ".join([f"`{c}` {types[c]}" for c in by] + [f"{c} double" for c in ("tau", "n", *names)])
    total = rows.mapInArrow(traced, schema).groupBy(*by, "tau").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    mean = {c: F.col(c) / F.col("n") for c in names}
    return total.select(*by, "tau", F.col("n").cast("long").alias("n"), mean["nll"].alias("nll"), (1 - mean["top1"]).alias("error"), *[mean[c].alias(c) for c in names[1:]])


def with_fitted(trace: DataFrame, by: list[str], name: str, objective: str = "nll") -> DataFrame:
    """trace with the scale of the least loss of its group; of equal ones (to nine digits) the smallest. A window holds
    the scales of a group."""
    return trace.withColumn(name, F.min_by("tau", F.struct(F.round(objective, 9), "tau")).over(Window.partitionBy(*by)))


def invariance(cases: DataFrame, weights: DataFrame, priors: DataFrame, orders: int) -> DataFrame:
    """row_id, mean_jsd and max_deviation of the fused vectors over hash-ordered permutations of a case's tokens.

    Sums run in the order of each permutation, so what is left is rounding. cases: row_id, token; weights as in wide_sums.
    """
    from tallyloom.functions.vectors import jsd, softmax

    by_token = weights.groupBy("token").agg(in_order(bounded()).alias("w"))  # the labels
    own = cases.join(F.broadcast(by_token), "token").groupBy("row_id").agg(F.collect_list(F.struct("token", "w")).alias("ts"))  # the tokens of a case
    own = own.crossJoin(F.broadcast(base_scores(priors)))  # one row
    keyed = lambda j: F.array_sort(F.transform("ts", lambda t: F.struct(F.sha1(F.concat_ws("|", F.lit("v"), F.col("row_id").cast("string"), j.cast("string"), t["token"])).alias("h"), t["w"].alias("w"))))
    scores = lambda j: F.aggregate(keyed(j), F.col("base"), lambda s, t: F.zip_with(s, t["w"], lambda a, b: a + b))
    fused_in = lambda j: F.get(F.transform(F.array(scores(j)), softmax), F.lit(0))
    own = own.select("row_id", F.explode(F.array(F.transform(F.sequence(F.lit(0), F.lit(orders - 1)), fused_in))).alias("p"))  # one row, so that the vectors are made once
    p = lambda j: F.get("p", F.lit(j))
    far = lambda j: F.array_max(F.zip_with(p(0), p(j), lambda a, b: F.abs(a - b)))
    two = F.array(*[jsd(p(i), p(j)) for i in range(orders) for j in range(i + 1, orders)])
    mean = F.aggregate(two, F.lit(0.0), lambda s, x: s + x) / F.size(two)
    return own.select("row_id", mean.alias("mean_jsd"), F.array_max(F.array(*[far(j) for j in range(1, orders)])).alias("max_deviation"))


def redundancy(contexts: DataFrame, tokens: DataFrame, rows: DataFrame, least_support: int, limit: int, most_jsd: float | None = None) -> DataFrame:
    """item_id, token, support and jsd: for each context up to ``limit`` tokens outside it that move its posterior least.

    A token counts if ``least_support`` rows hold it with the context, and the context itself has as many; with
    ``most_jsd`` only tokens that move it by no more. Equal ones (to nine digits) come by token. contexts: item_id, evidence.
    """
    base = conditioned(contexts, tokens, rows).filter(F.col("support") >= least_support).select("item_id", "label", F.col("p").alias("y"))
    counts = P.extended(bound_items(contexts, tokens), tokens, rows)
    full = counts.select("item_id", "token").distinct().join(base, "item_id").join(counts, ["item_id", "token", "label"], "left").fillna(0, ["n"])
    support = F.sum("n").over(Window.partitionBy("item_id", "token"))  # a row per label
    x, y = F.col("x"), F.col("y")
    term = lambda a: F.when(a > 1e-12, a * F.log2(a / ((x + y) / 2)) / 2).otherwise(0.0)
    moved = full.withColumn("support", support).withColumn("x", F.col("n") / F.col("support")).groupBy("item_id", "token", "support").agg(F.sum(term(x) + term(y)).alias("jsd"))
    moved = moved.filter(F.col("support") >= least_support)
    if most_jsd is not None:
        moved = moved.filter(F.col("jsd") <= most_jsd)
    k = F.row_number().over(Window.partitionBy("item_id").orderBy(F.round("jsd", 9), "token"))  # the vocabulary at most
    return moved.withColumn("k", k).filter(F.col("k") <= limit).drop("k")


def token_pairs(tokens: DataFrame, rows: DataFrame, least: int) -> DataFrame:
    """label, a, b, phi and mi (nats) of every pair of tokens inside a label whose counts lie in [least, n - least].

    Pairs come from a row's own tokens, whose number is bounded, once for all rows with equal tokens; pairs that never meet count as zero meetings. The result
    itself has a row for every two tokens of a label, the vocabulary squared.
    """
    sets = P.counted_sets(tokens, rows)
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    one = sets.select("label", F.col("n").alias("k"), F.explode("held").alias("token")).groupBy("label", "token").agg(F.sum("k").alias("c")).join(n, "label").filter(F.col("c").between(F.lit(least), F.col("n") - least))
    a, b = one.select("label", "n", F.col("token").alias("a"), F.col("c").alias("ca")), one.select("label", F.col("token").alias("b"), F.col("c").alias("cb"))
    grid = a.join(b, "label").filter("a < b")  # vocabulary squared, per label
    both = P.counted_pairs(sets).withColumnRenamed("n", "n11")
    g = grid.join(both, ["label", "a", "b"], "left").fillna(0, ["n11"])
    n11, ca, cb, m = F.col("n11").cast("double"), F.col("ca").cast("double"), F.col("cb").cast("double"), F.col("n").cast("double")
    phi = (n11 * m - ca * cb) / F.sqrt(ca * cb * (m - ca) * (m - cb))

    def cell(k: Column, r: Column, c: Column) -> Column:
        return F.when(k > 0, k / m * F.ln(k * m / (r * c))).otherwise(0.0)

    mi = cell(n11, ca, cb) + cell(ca - n11, ca, m - cb) + cell(cb - n11, m - ca, cb) + cell(m - ca - cb + n11, m - ca, m - cb)
    return g.select("label", "a", "b", phi.alias("phi"), mi.alias("mi"))
