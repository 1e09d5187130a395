"""Reports over estimators: one row for a model, or a row for each group, with intervals from resampled units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import quality as Q, sampling as S
from tallyloom.operators.kept import kept

#: The least standard error in a weight, and how near 0 a stated change is a tie.
LEAST_ERROR, TIE = 1e-3, 1e-8
SEVERITIES = ["critical", "major", "minor", "info"]


def line(sums: DataFrame) -> DataFrame:
    """sums with slope, intercept and r_squared of the weighted line; sums: w, wx, wy, wxx, wxy, wyy. Null without spread."""
    m = lambda c: F.col(c) / F.col("w")
    vx, vy, cov = m("wxx") - m("wx") * m("wx"), m("wyy") - m("wy") * m("wy"), m("wxy") - m("wx") * m("wy")
    slope = F.when(vx > 1e-12, cov / vx)
    return sums.withColumns({"slope": slope, "intercept": m("wy") - slope * m("wx"), "r_squared": F.when((vx > 1e-12) & (vy > 1e-12), cov * cov / (vx * vy))})


def update_summary(points: DataFrame, by: list[str], replicates: int, seed: str = "a2") -> DataFrame:
    """by, n_items, n_points, slope with low and high, intercept, r_squared, spearman, error, agreement and tie_rate.

    points: item_id, label, true_delta, stated_delta, se. The line is weighted by 1 / max(se, LEAST_ERROR) squared. Stated
    changes of zero are ties: they count in tie_rate and not in agreement. Points are resampled for the interval.
    """
    x, y = F.col("true_delta"), F.col("stated_delta")
    w = 1 / F.pow(F.greatest("se", F.lit(LEAST_ERROR)), F.lit(2))
    rows = points.dropna(subset=["true_delta", "stated_delta", "se"]).withColumn("w", w).withColumn("point", F.concat_ws("|", "item_id", "label"))
    sums = {"wx": F.col("w") * x, "wy": F.col("w") * y, "wxx": F.col("w") * x * x, "wxy": F.col("w") * x * y, "wyy": F.col("w") * y * y}
    rows = rows.withColumns(sums)
    tie = F.abs(y) <= TIE
    own = line(rows.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ["w", *sums]], F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_points"), F.avg(F.abs(y - x)).alias("error"),
        F.avg(F.when(~tie, (F.signum(x) == F.signum(y)).cast("int"))).alias("agreement"), F.avg(tie.cast("int")).alias("tie_rate"),
    ))
    drawn = line(S.resampled(rows, "point", ["w", *sums], replicates, seed, by)).select(*by, F.col("slope").alias("v"))
    out = S.beside(own, S.interval(drawn, by=by), by)
    out = S.beside(out, Q.spearman(rows, by, "true_delta", "stated_delta"), by)
    return out.select(*by, "n_items", "n_points", "slope", "low", "high", "intercept", "r_squared", "spearman", "error", "agreement", "tie_rate")


def order_summary(effects: DataFrame, shapes: DataFrame, rates: DataFrame, ceiling: DataFrame, replicates: int) -> DataFrame:
    """One row: n_cases, order_effect with low and high, jsd_permutation, jsd_retest, normalised, flip_rate and informative_rate.

    effects: arms.order_effect; shapes: arms.case_shape; rates: arm and informative_rate, which weigh alike; ceiling: one row.
    normalised is the effect over the room between retests and ceiling, null without room. Missing values are left out.
    """
    mean = effects.agg(F.count("*").alias("n_cases"), F.avg("jsd_permutation").alias("jsd_permutation"), F.avg("jsd_retest").alias("jsd_retest"))
    effect = S.bootstrap_mean(effects, "order_effect", "case_id", replicates, "a1").select(F.col("mean").alias("order_effect"), "low", "high")
    out = mean.crossJoin(F.broadcast(effect)).crossJoin(F.broadcast(ceiling))  # a row each, as below
    out = out.crossJoin(F.broadcast(shapes.agg(F.avg(F.col("flips").cast("int")).alias("flip_rate")))).crossJoin(F.broadcast(rates.agg(F.avg("informative_rate").alias("informative_rate"))))
    room = F.col("ceiling") - F.col("jsd_retest")
    return out.withColumn("normalised", F.when(room > 1e-9, F.col("order_effect") / room))


def redundancy_summary(items: DataFrame, floor: DataFrame) -> DataFrame:
    """One row over items (jsd, certified, entropy_change, flip) and a model's retest floor (one row, floor): n, mean, median
    and p90 of jsd, certified, ratio to it, excess over the floor, share above it, flip_rate, entropy_change, inflation_rate."""
    both = items.crossJoin(F.broadcast(floor))  # one row
    j = F.col("jsd")
    own = both.agg(
        F.count("*").alias("n"), F.avg(j).alias("mean"), F.avg("certified").alias("certified"), F.max("floor").alias("floor"), F.avg((j > F.col("floor")).cast("int")).alias("share_above"),
        F.avg(F.col("flip").cast("int")).alias("flip_rate"), F.avg("entropy_change").alias("entropy_change"), F.avg((F.col("entropy_change") < 0).cast("int")).alias("inflation_rate"),
    )
    places = Q.quantiles(items, [], "jsd", {"median": 0.5, "p90": 0.9})
    out = own.crossJoin(F.broadcast(places))  # a row each
    return out.withColumns({"ratio": F.when(F.col("certified") > 0, F.col("mean") / F.col("certified")), "excess": F.col("mean") - F.col("floor")})


def validation(pairs: DataFrame, k: int) -> DataFrame:
    """One row over pairs of vectors (made, shipped): n, jsd_mean, jsd_median, jsd_p90, top1_agreement, top_k_jaccard."""
    a, b = F.col("shipped"), F.col("made")
    rows = kept(pairs.select(V.jsd(a, b).alias("jsd"), (V.top1(a) == V.top1(b)).cast("int").alias("same"), V.jaccard(V.top_k(a, k), V.top_k(b, k)).alias("shared")))
    own = rows.agg(F.count("*").alias("n"), F.avg("jsd").alias("jsd_mean"), F.avg("same").alias("top1_agreement"), F.avg("shared").alias("top_k_jaccard"))
    return own.crossJoin(F.broadcast(Q.quantiles(rows, [], "jsd", {"jsd_median": 0.5, "jsd_p90": 0.9})))  # a row each


def regime(error: Column, floor: Column) -> Column:
    """ABSOLUTE if the reconstruction's error is within the data's own noise."""
    return F.when(error <= floor, "ABSOLUTE").otherwise("RELATIVE")


def named_ranks(rows: DataFrame) -> DataFrame:
    """rows (v, named, truth) with stated_hit, named_hit and rank of the named entry in v, 1 for the first."""
    inside = (F.col("named") >= 0) & (F.col("named") < F.size("v"))
    return rows.withColumns({
        "stated_hit": (V.top1(F.col("v")) == F.col("truth")).cast("int"), "named_hit": (F.col("named") == F.col("truth")).cast("int"), "rank": F.when(inside, V.rank_of(F.col("v"), F.col("named"))),
    })


def belief_gap(rows: DataFrame) -> DataFrame:
    """One row over rows (v, named, truth, told): n, those that only the stated vector or only the named answer gets right,
    agreement of both over all and over the informative (told), the share that is not, their accuracy, and McNemar's statistic."""
    hits = named_ranks(rows).withColumn("same", (V.top1(F.col("v")) == F.col("named")).cast("int"))
    told, a, b = F.col("told"), F.col("stated_hit") == 1, F.col("named_hit") == 1
    n = hits.agg(
        F.count("*").alias("n"), F.count_if(a & ~b).alias("only_stated"), F.count_if(~a & b).alias("only_named"), F.avg("same").alias("agreement"), F.avg(F.when(told, F.col("same"))).alias("agreement_informative"),
        F.avg((~told).cast("int")).alias("uniform_share"), F.avg(F.when(told, F.col("stated_hit"))).alias("accuracy_informative"),
    )
    x, y = F.col("only_stated"), F.col("only_named")
    return n.withColumn("chi_squared", F.when(x + y > 0, (F.abs(x - y) - 1) * (F.abs(x - y) - 1) / (x + y)))


def finding(check: str, rows: DataFrame, severity: Column | str, headline: Column) -> DataFrame:
    """check, severity and headline of a table of one row."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(F.lit(check).alias("check"), level.alias("severity"), headline.alias("headline"))


def assembled(findings: list[DataFrame]) -> DataFrame:
    """All findings with place, by severity and name; an unknown severity is an error when the rows are read."""
    out, *rest = findings
    for f in rest:
        out = out.unionByName(f)
    known = F.array(*[F.lit(s) for s in SEVERITIES])
    rank = F.nullif(F.array_position(known, F.col("severity")), F.lit(0).cast("long"))
    checked = F.coalesce(rank, F.raise_error(F.concat(F.lit("unknown severity "), F.col("severity"))).cast("long"))
    return out.withColumn("rank", checked.cast("int")).orderBy("rank", "check")


def retention(traces: DataFrame, model: str) -> DataFrame:
    """A row per model: best_tau (most top1, the smallest among equals), best, direct (scale 1) and retention, best over direct.

    traces: model, tau, top1. All rows carry pearson, the correlation of direct accuracy and retention over the models.
    """
    best = traces.groupBy(model).agg(F.min_by(F.struct("tau", "top1"), F.struct(F.round(-F.col("top1"), 9), "tau")).alias("b"), F.max(F.when(F.col("tau") == 1.0, F.col("top1"))).alias("direct"))
    rows = best.select(model, F.col("b.tau").alias("best_tau"), F.col("b.top1").alias("best"), "direct", (F.col("b.top1") / F.nullif(F.col("direct"), F.lit(0.0))).alias("retention"))
    return rows.crossJoin(F.broadcast(rows.agg(F.corr("direct", "retention").alias("pearson"))))  # one row


def gap_ratio(gaps: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n models, the ratio of the sums of two gaps, and the mean of the models' own ratios."""
    return gaps.agg(F.count("*").alias("n"), (F.sum(x) / F.nullif(F.sum(y), F.lit(0.0))).alias("ratio"), F.avg(F.col(x) / F.nullif(F.col(y), F.lit(0.0))).alias("mean_ratio"))
