"""Conditioning, likelihoods and fusion over orders and the brands of their lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import conditioning as K, figures
from tallyloom.operators.kept import kept
from tallyloom.plans.bindings import C, corpus, exploded, once, query, r6

#: Evidence sets: consecutive brands, singles, an unknown token beside a known one, only unknown ones.
ITEMS = [(k, [f"Brand#{k}", f"Brand#{k % 20 + 1}"]) for k in range(1, 21)] + [(100 + k, [f"Brand#{k}"]) for k in range(1, 26)] + [(200, ["Brand#3", "nope"]), (201, ["nope"]), (202, [])]
ITEM_SQL = "items(item_id, token) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, ts in ITEMS for t in ts) + "), ids(item_id) AS (VALUES " + ", ".join(f"({i})" for i, _ in ITEMS) + ")"
COND = f"""{C}, {ITEM_SQL}, k AS (SELECT i.* FROM items i WHERE token IN (SELECT token FROM t)), need AS (SELECT item_id, count(*) AS need FROM k GROUP BY 1),
  m AS (SELECT item_id, row_id, label FROM (SELECT k.item_id, t.row_id, t.label, count(*) AS have FROM k JOIN t USING (token) GROUP BY ALL) JOIN need USING (item_id) WHERE have = need
        UNION ALL SELECT item_id, row_id, label FROM ids CROSS JOIN c WHERE item_id NOT IN (SELECT item_id FROM need)),
  n AS (SELECT item_id, label, count(*) AS n FROM m GROUP BY 1, 2),
  x AS (SELECT item_id, label, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY item_id)::BIGINT AS support FROM (SELECT item_id, label FROM ids CROSS JOIN (SELECT DISTINCT label FROM c)) LEFT JOIN n USING (item_id, label)),
  q AS (SELECT *, CASE WHEN support > 0 THEN n / support ELSE 0.2 END AS p FROM x)"""
L = f"""{C}, nd AS (SELECT label, count(*) AS n_d FROM c GROUP BY 1), de AS (SELECT label, token, count(*) AS n_de FROM t GROUP BY 1, 2),
  lk AS (SELECT label, token, coalesce(n_de, 0) AS n_de, n_d, (coalesce(n_de, 0) + 0.5) / (n_d + 1) AS p, ln(n_d / (SELECT count(*) FROM c)) AS log_prior
         FROM (SELECT * FROM nd CROSS JOIN (SELECT DISTINCT token FROM t)) LEFT JOIN de USING (label, token)),
  mr AS (SELECT *, ln(least(greatest(p, 1e-6), 1 - 1e-6)) - ln(least(greatest((sum(p * exp(log_prior)) OVER (PARTITION BY token) - p * exp(log_prior)) / greatest(1 - exp(log_prior), 1e-12), 1e-6), 1 - 1e-6)) AS log_ratio FROM lk),
  cr AS (SELECT label, token, ln(least(greatest(p, 1e-9), 1 - 1e-9)) - ln(least(greatest((sum(n_de) OVER (PARTITION BY token) - n_de + 0.5) / (sum(n_d) OVER (PARTITION BY token) - n_d + 1), 1e-9), 1 - 1e-9)) AS log_ratio FROM lk),
  es AS (SELECT t.row_id, w.label, sum(least(greatest(log_ratio, -7), 7)) AS s FROM t JOIN cr w USING (token) GROUP BY 1, 2),
  pr AS (SELECT label, n_d / (SELECT count(*) FROM c) AS p FROM nd)"""
GRID = K.FIT_GRID


def tau_sql(grid):
    """z: scores by row, scale and label; ls: losses by row and scale."""
    return f"""{L}, g AS (SELECT es.row_id, tau, es.label, ln(greatest(p, 1e-9)) + tau * s AS z FROM es JOIN pr USING (label) CROSS JOIN (VALUES {", ".join(f"({g}::DOUBLE)" for g in grid)}) v(tau)),
  sm AS (SELECT *, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p FROM g WINDOW w AS (PARTITION BY row_id, tau)),
  rk AS (SELECT sm.row_id, tau, sm.label, c.label AS truth, p, row_number() OVER (PARTITION BY sm.row_id, tau ORDER BY p DESC, sm.label) AS k FROM sm JOIN c USING (row_id)),
  ls AS (SELECT row_id, tau, -ln(greatest(max(p) FILTER (WHERE label = truth), 1e-12)) AS nll, max((k = 1)::INT) FILTER (WHERE label = truth) AS top1, max((k <= 2)::INT) FILTER (WHERE label = truth) AS top2,
      sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS entropy FROM rk GROUP BY 1, 2)"""


TAU = tau_sql(GRID)
TRACE = ["nll", "error", "top1", "top2", "entropy"]


def frames(spark, d):
    """The corpus and its tokens. A query reads them several times: they are kept, dealt by row_id."""
    rows = once(("corpus", d), lambda: kept(corpus(spark, d)))
    return rows, exploded(rows)


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id int, evidence array<string>")


def conditioned(spark, d):
    rows, tokens = frames(spark, d)
    return K.conditioned(items(spark), tokens, rows)


@query("o065_matches", f"WITH {COND} SELECT item_id, count(*) AS n_rows FROM m GROUP BY 1")
def matches(spark, d):
    rows, tokens = frames(spark, d)
    return K.supports(items(spark), tokens, rows).withColumnRenamed("support", "n_rows")


@query("o066_posterior", f"WITH {COND} SELECT item_id, label, n, support, round(p, 6) AS p FROM q")
def posterior(spark, d):
    return conditioned(spark, d).withColumn("p", r6(F.col("p")))


@query("o067_prior", f"WITH {C} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS p FROM c GROUP BY 1")
def prior(spark, d):
    return K.prior(corpus(spark, d)).withColumn("p", r6(F.col("p")))


@query("o068_standard_error", f"WITH {COND} SELECT item_id, label, round(sqrt(p * (1 - p) / greatest(support, 1)), 6) AS se FROM q")
def standard_error(spark, d):
    return conditioned(spark, d).select("item_id", "label", r6(K.standard_error(F.col("p"), F.col("support"))).alias("se"))


WILSON = "round(greatest(0, (p + {z}*{z}/(2*{n}))/(1 + {z}*{z}/{n}) - {z}/(1 + {z}*{z}/{n}) * sqrt(p*(1-p)/{n} + {z}*{z}/(4.0*{n}*{n}))), 6) AS low, round(least(1, (p + {z}*{z}/(2*{n}))/(1 + {z}*{z}/{n}) + {z}/(1 + {z}*{z}/{n}) * sqrt(p*(1-p)/{n} + {z}*{z}/(4.0*{n}*{n}))), 6) AS high"


@query("o069_wilson", f"WITH {COND} SELECT item_id, label, {WILSON.format(z=K.Z_VECTOR, n='support')} FROM q WHERE support > 0")
def wilson(spark, d):
    low, high = K.wilson(F.col("p"), F.col("support"))
    return conditioned(spark, d).filter("support > 0").select("item_id", "label", r6(low).alias("low"), r6(high).alias("high"))


@query("o070_wilson_scalar", f"WITH h AS (SELECT l_returnflag, avg((l_quantity > 25)::INT) AS p, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, {WILSON.format(z=1.96, n='n')} FROM h")
def wilson_scalar(spark, d):
    from tallyloom.plans.bindings import table

    h = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg((F.col("l_quantity") > 25).cast("int")).alias("p"), F.count("*").alias("n"))
    low, high = K.wilson(F.col("p"), F.col("n"), K.Z_SCALAR)
    return h.select("l_returnflag", r6(low).alias("low"), r6(high).alias("high"))


@query("o071_delta_log_odds", f"WITH {COND}, o AS (SELECT *, ln(least(greatest(p, 1e-4), 1 - 1e-4) / (1 - least(greatest(p, 1e-4), 1 - 1e-4))) AS lo FROM q) SELECT a.item_id, a.label, round(a.lo - b.lo, 6) AS delta FROM o a JOIN o b ON a.label = b.label AND b.item_id = a.item_id + 100 WHERE a.item_id <= 20")
def delta_log_odds(spark, d):
    q = conditioned(spark, d).select("item_id", "label", K.log_odds(F.col("p")).alias("lo"))
    before = q.filter("item_id between 101 and 120").select((F.col("item_id") - 100).alias("item_id"), "label", F.col("lo").alias("b"))
    return q.filter("item_id <= 20").join(before, ["item_id", "label"]).select("item_id", "label", r6(F.col("lo") - F.col("b")).alias("delta"))


@query("o072_scorable", f"WITH {COND} SELECT item_id, max(support) AS support FROM q GROUP BY 1 HAVING max(support) >= 250")
def scorable(spark, d):
    return conditioned(spark, d).groupBy("item_id").agg(F.max("support").alias("support")).filter("support >= 250")


@query("o073_redundancy_candidates", f"""WITH {COND}, s AS (SELECT m.item_id, t.token, m.label, count(*) AS n FROM m JOIN t USING (row_id) WHERE m.item_id BETWEEN 101 AND 125 AND m.item_id - 100 <> substr(t.token, 7)::INT GROUP BY ALL),
    f AS (SELECT item_id, token, l.label, coalesce(n, 0) AS n FROM (SELECT DISTINCT item_id, token FROM s) CROSS JOIN (SELECT DISTINCT label FROM c) l LEFT JOIN s USING (item_id, token, label)),
    g AS (SELECT f.item_id, token, f.label, f.n / sum(f.n) OVER (PARTITION BY f.item_id, token) AS x, sum(f.n) OVER (PARTITION BY f.item_id, token)::BIGINT AS support, q.p AS y FROM f JOIN q ON q.item_id = f.item_id AND q.label = f.label),
    j AS (SELECT item_id, token, support, sum(CASE WHEN x > 1e-12 THEN x * log2(x / ((x + y) / 2)) / 2 ELSE 0 END + CASE WHEN y > 1e-12 THEN y * log2(y / ((x + y) / 2)) / 2 ELSE 0 END) AS jsd FROM g GROUP BY 1, 2, 3)
    SELECT item_id, token, support, round(jsd, 6) AS jsd FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(jsd, 9), token) AS k FROM j WHERE support >= 100) WHERE k <= 3""")
def redundancy_candidates(spark, d):
    rows, tokens = frames(spark, d)
    out = K.redundancy(items(spark).filter("item_id between 101 and 125"), tokens, rows, 100, 3)
    return out.select("item_id", "token", "support", r6(F.col("jsd")).alias("jsd"))


@query("o074_likelihood", f"WITH {L} SELECT label, token, n_de, n_d, round(p, 6) AS p, round(log_prior, 6) AS log_prior FROM lk")
def likelihood(spark, d):
    rows, tokens = frames(spark, d)
    t = K.likelihoods(tokens, rows)
    return t.withColumn("p", r6(F.col("p"))).withColumn("log_prior", r6(F.col("log_prior")))


@query("o075_mixture_ratio", f"WITH {L} SELECT label, token, round(log_ratio, 6) AS log_ratio FROM mr")
def mixture_ratio(spark, d):
    rows, tokens = frames(spark, d)
    return K.mixture_ratio(K.likelihoods(tokens, rows)).select("label", "token", r6(F.col("log_ratio")).alias("log_ratio"))


@query("o076_count_ratio", f"WITH {L} SELECT label, token, round(log_ratio, 6) AS log_ratio FROM cr")
def count_ratio(spark, d):
    rows, tokens = frames(spark, d)
    return K.count_ratio(tokens, rows).withColumn("log_ratio", r6(F.col("log_ratio")))


def nb(absences):
    gain = "ln(p) - ln(1 - p)" if absences else "ln(p)"
    extra = "+ (SELECT sum(ln(1 - p)) FROM lk k WHERE k.label = z.label)" if absences else ""
    return f"""WITH {L}, z AS (SELECT t.row_id, lk.label, sum({gain}) + max(log_prior) AS g FROM t JOIN lk USING (token) GROUP BY 1, 2), w AS (SELECT row_id, label, g {extra} AS g FROM z)
      SELECT row_id, label, round(exp(g - max(g) OVER (PARTITION BY row_id)) / sum(exp(g)) OVER (PARTITION BY row_id) * exp(max(g) OVER (PARTITION BY row_id)), 5) AS p FROM w"""


for _absences in (False, True):

    @query("o077_naive_bayes" + "_absences" * _absences, nb(_absences))
    def naive_bayes(spark, d, absences=_absences):
        rows, tokens = frames(spark, d)
        return K.naive_bayes(tokens.select("row_id", "token"), K.likelihoods(tokens, rows), absences).withColumn("p", F.round("p", 5))


@query("o079_independence", f"""WITH {L}, o AS (SELECT label, token, count(*) AS c FROM t GROUP BY 1, 2), g AS (SELECT a.label, a.token AS a, b.token AS b, a.c::DOUBLE AS ca, b.c::DOUBLE AS cb, n_d::DOUBLE AS m FROM o a JOIN o b ON a.label = b.label AND a.token < b.token JOIN nd ON nd.label = a.label WHERE a.c BETWEEN 20 AND n_d - 20 AND b.c BETWEEN 20 AND n_d - 20),
    n AS (SELECT a.label, a.token AS a, b.token AS b, count(*) AS n FROM t a JOIN t b ON a.row_id = b.row_id AND a.token < b.token GROUP BY 1, 2, 3), h AS (SELECT g.*, coalesce(n, 0)::DOUBLE AS k FROM g LEFT JOIN n USING (label, a, b)),
    f AS (SELECT label, (k * m - ca * cb) / sqrt(ca * cb * (m - ca) * (m - cb)) AS phi, CASE WHEN k > 0 THEN k / m * ln(k * m / (ca * cb)) ELSE 0 END + CASE WHEN ca > k THEN (ca - k) / m * ln((ca - k) * m / (ca * (m - cb))) ELSE 0 END
      + CASE WHEN cb > k THEN (cb - k) / m * ln((cb - k) * m / ((m - ca) * cb)) ELSE 0 END + CASE WHEN m - ca - cb + k > 0 THEN (m - ca - cb + k) / m * ln((m - ca - cb + k) * m / ((m - ca) * (m - cb))) ELSE 0 END AS mi FROM h)
    SELECT label, count(*) AS n_pairs, round(avg(abs(phi)), 6) AS mean_phi, round(median(abs(phi)), 6) AS median_phi, round(quantile_cont(abs(phi), 0.95), 6) AS p95_phi, round(max(abs(phi)), 6) AS max_phi, round(avg((abs(phi) > 0.1)::INT), 6) AS share, round(avg(mi), 8) AS mean_mi FROM f GROUP BY 1""")
def independence(spark, d):
    from tallyloom.operators import quality as Q

    rows, tokens = frames(spark, d)
    pairs = K.token_pairs(tokens, rows, 20).withColumn("phi", F.abs("phi"))
    means = pairs.groupBy("label").agg(F.count("*").alias("n_pairs"), r6(F.avg("phi")).alias("mean_phi"), r6(F.max("phi")).alias("max_phi"), r6(F.avg((F.col("phi") > 0.1).cast("int"))).alias("share"), F.round(F.avg("mi"), 8).alias("mean_mi"))
    places = Q.quantiles(pairs, ["label"], "phi", {"median_phi": 0.5, "p95_phi": 0.95})
    return means.join(places.select("label", r6(F.col("median_phi")).alias("median_phi"), r6(F.col("p95_phi")).alias("p95_phi")), "label")


@query("o081_fusion", f"WITH {L}, z AS (SELECT row_id, label, ln(greatest(p, 1e-9)) + s AS g FROM es JOIN pr USING (label)) SELECT row_id, label, round(exp(g) / sum(exp(g)) OVER (PARTITION BY row_id), 5) AS p FROM z")
def fusion(spark, d):
    rows, tokens = frames(spark, d)
    return K.fused(K.evidence_sums(tokens.select("row_id", "token"), K.count_ratio(tokens, rows)), K.prior(rows)).withColumn("p", F.round("p", 5))


@query("o082_evidence_sums", f"WITH {L} SELECT row_id, label, round(s, 5) AS s FROM es")
def evidence_sums(spark, d):
    rows, tokens = frames(spark, d)
    return K.evidence_sums(tokens.select("row_id", "token"), K.count_ratio(tokens, rows)).withColumn("s", F.round("s", 5))


def trace(spark, d, grid=GRID, by=None, fold=None):
    """Mean losses by scale (and by): hits among two labels in place of five, since there are five."""
    rows, tokens = frames(spark, d)
    cases = tokens if fold is None else tokens.withColumn("fold", fold)
    return K.scale_trace(K.wide_sums(cases, K.count_ratio(tokens, rows), ["label", *(by or [])]), K.prior(rows), "label", grid, by, top=2)


@query("o083_scaled_fusion", f"WITH {L}, z AS (SELECT row_id, label, ln(greatest(p, 1e-9)) + 0.5 * s AS g FROM es JOIN pr USING (label)) SELECT row_id, label, round(exp(g) / sum(exp(g)) OVER (PARTITION BY row_id), 5) AS p FROM z")
def scaled_fusion(spark, d):
    rows, tokens = frames(spark, d)
    return K.fused(K.evidence_sums(tokens.select("row_id", "token"), K.count_ratio(tokens, rows)), K.prior(rows), 0.5).withColumn("p", F.round("p", 5))


@query("o084_tau_grid", f"""WITH {TAU}, tr AS (SELECT tau, avg(nll) AS nll, 1 - avg(top1) AS error FROM ls GROUP BY 1),
    b AS (SELECT min_by(tau, struct_pack(a := round(nll, 9), b := tau)) AS by_nll, min_by(tau, struct_pack(a := round(error, 9), b := tau)) AS by_error FROM tr)
    SELECT tau, round(nll, 5) AS nll, round(error, 6) AS error, by_nll, by_error FROM tr, b""")
def tau_grid(spark, d):
    fitted = K.with_fitted(K.with_fitted(trace(spark, d), [], "by_nll"), [], "by_error", "error")
    return fitted.select("tau", F.round("nll", 5).alias("nll"), r6(F.col("error")).alias("error"), "by_nll", "by_error")


@query("o085_cross_fit", f"""WITH {TAU}, f AS (SELECT tau, (('0x' || substr(sha1(row_id::VARCHAR), 1, 1))::INT % 2)::INT AS fold, nll FROM ls), gg AS (SELECT fold, tau, avg(nll) AS nll FROM f GROUP BY 1, 2),
    b AS (SELECT fold AS fit_fold, min_by(tau, struct_pack(a := round(nll, 9), b := tau)) AS tau FROM gg GROUP BY 1) SELECT gg.fold, gg.tau, round(gg.nll, 5) AS nll FROM gg JOIN b ON b.fit_fold <> gg.fold AND b.tau = gg.tau""")
def cross_fit(spark, d):
    fold = F.conv(F.substring(F.sha1(F.col("row_id").cast("string")), 1, 1), 16, 10).cast("int") % 2
    g = K.with_fitted(trace(spark, d, by=["fold"], fold=fold), ["fold"], "best")
    other = F.max(F.when(F.col("fold") == 0, F.col("best"))).over(Window.partitionBy()), F.max(F.when(F.col("fold") == 1, F.col("best"))).over(Window.partitionBy())  # two folds of a few scales
    return g.withColumn("given", F.when(F.col("fold") == 0, other[1]).otherwise(other[0])).filter("tau = given").select("fold", "tau", F.round("nll", 5).alias("nll"))


@query("o089_coverage", f"WITH {L} SELECT round(avg((n_de >= 100)::INT), 6) AS coverage, count(*) AS n FROM lk")
def coverage(spark, d):
    rows, tokens = frames(spark, d)
    return K.likelihoods(tokens, rows).agg(r6(F.avg((F.col("n_de") >= 100).cast("int"))).alias("coverage"), F.count("*").alias("n"))


BANDS = [(0, 17), (18, 39), (40, 64), (65, 90)]


@query("o090_band_prior", f"WITH {C}, b(lo, hi) AS (VALUES {', '.join(map(str, BANDS))}), p AS (SELECT lo, hi, sex, avg((label = '1-URGENT')::INT) AS p FROM c JOIN b ON age BETWEEN lo AND hi WHERE sex <> 'P' GROUP BY ALL) SELECT c.row_id, round(coalesce(p.p, (SELECT avg((label = '1-URGENT')::INT) FROM c)), 6) AS p FROM c LEFT JOIN p ON c.age BETWEEN lo AND hi AND c.sex = p.sex")
def band_prior(spark, d):
    rows = corpus(spark, d)
    bands = F.broadcast(spark.createDataFrame(BANDS, "lo int, hi int"))  # the bands of BANDS
    urgent = F.avg((F.col("label") == "1-URGENT").cast("int"))
    known = rows.filter("sex <> 'P'").join(bands, F.col("age").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi", "sex").agg(urgent.alias("p"))
    known = F.broadcast(known.withColumnRenamed("sex", "s"))  # bands times sexes
    fallback = F.broadcast(rows.agg(urgent.alias("q")))  # one row
    return rows.join(known, F.col("age").between(F.col("lo"), F.col("hi")) & (F.col("sex") == F.col("s")), "left").crossJoin(fallback).select("row_id", r6(F.coalesce("p", "q")).alias("p"))


@query("o108_frontier", f"WITH {tau_sql(K.FRONTIER_GRID)} SELECT tau, count(*) AS n, round(avg(nll), 5) AS nll, round(1 - avg(top1), 6) AS error, round(avg(top1), 6) AS top1, round(avg(top2), 6) AS top2, round(avg(entropy), 5) AS entropy FROM ls GROUP BY 1")
def frontier(spark, d):
    t = trace(spark, d, K.FRONTIER_GRID)
    return t.select("tau", "n", *[F.round(c, 5 if c in ("nll", "entropy") else 6).alias(c) for c in TRACE])


@query("o125_scale_extremes", f"""WITH {tau_sql(K.FRONTIER_GRID)}, tr AS (SELECT tau, avg(nll) AS nll, avg(top1) AS top1, avg(entropy) AS entropy FROM ls GROUP BY 1)
    SELECT min_by(tau, struct_pack(a := round(-top1, 9), b := tau)) AS top1_at, round(max(top1), 6) AS top1, min_by(tau, struct_pack(a := round(nll, 9), b := tau)) AS nll_at, round(min(nll), 5) AS nll, min_by(tau, struct_pack(a := round(entropy, 9), b := tau)) AS entropy_at, round(min(entropy), 5) AS entropy FROM tr""")
def scale_extremes(spark, d):
    out = figures.extremes(trace(spark, d, K.FRONTIER_GRID), [], "tau", ["top1"], ["nll", "entropy"])
    return out.select("top1_at", r6(F.col("top1")).alias("top1"), "nll_at", F.round("nll", 5).alias("nll"), "entropy_at", F.round("entropy", 5).alias("entropy"))
