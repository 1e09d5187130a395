"""Reports, items of a battery, validation of a reconstruction and handling of responses over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import arms, battery as B, comparison as M, conditioning as K, quality as Q, reports as R, sampling as S
from tallyloom.operators.kept import kept
from tallyloom.plans.audit_queries import BODY, PRED, RESPONSES, predictions
from tallyloom.plans.bindings import C, JSD, P20, RESP, posteriors, query, r6, responses, runs, table
from tallyloom.plans.comparison_queries import POINTS, points
from tallyloom.plans.corpus_queries import COND, L, frames, tau_sql
from tallyloom.plans.vector_queries import CEILING, EFFECT
from tallyloom.sources import responses as X

N = 50


def rounded(df, keep, floats, digits=6):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in floats])


@query("o006_meta", "SELECT event_id, event_type, props->>'$.k' AS k FROM events")
def meta(spark, d):
    return X.expanded(table(spark, d, "events").select("event_id", "event_type", "props"), "props")


@query("o036_repaired", f"""WITH k AS (SELECT event_id, (props->>'$.k')::INT AS k FROM events), v AS (SELECT event_id, k, k % 7 AS z, greatest(k - 10, 0)::DOUBLE AS a, greatest(k - 10, 0)::DOUBLE + greatest(k % 5 - 2, 0) + greatest(40 - k, 0) AS s FROM k)
    SELECT event_id, k % 3 = 0 OR z < 4 AS valid, CASE WHEN k % 3 = 0 THEN 0.2 WHEN z >= 4 THEN NULL WHEN s > 0 THEN round(a / s, 6) ELSE round(1.0 / 3, 6) END::DOUBLE AS first FROM v""")
def repaired(spark, d):
    """A third of the responses was parsed; the others only have their raw text."""
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("b", F.expr(BODY))
    done = F.col("k") % 3 == 0
    rows = rows.select("event_id", F.when(done, F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))).alias("parsed"), done.alias("valid"), F.when(~done, F.expr(RESPONSES)).alias("raw_text"))
    return X.repaired(rows, 3).select("event_id", "valid", r6(F.get("parsed", F.lit(0))).alias("first"))


# summaries of the estimators

LINE_SQL = "(sum(w * {k} * x * y) / sum(w * {k}) - sum(w * {k} * x) / sum(w * {k}) * sum(w * {k} * y) / sum(w * {k})) / (sum(w * {k} * x * x) / sum(w * {k}) - (sum(w * {k} * x) / sum(w * {k})) ** 2)"


def update_sql(by):
    """SQL of R.update_summary; by: a column of the points, or empty."""
    group, part = (f"GROUP BY {by}", f"PARTITION BY {by} ") if by else ("", "")
    pick, using = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    return f"""{POINTS}, ptx AS (SELECT item_id, label, true_delta AS x, stated_delta AS y, item_id || '|' || label AS point, 1 / greatest(se, 1e-3) ** 2 AS w FROM pt),
      {S.weights_sql("ptx", "point", "a2", N).replace(" AS w FROM", " AS k FROM")},
      b AS (SELECT {pick}r, {LINE_SQL.format(k="k")} AS v FROM ptx JOIN weights USING (point) GROUP BY {pick}r), iv AS (SELECT {pick}quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM b {group}),
      rk AS (SELECT *, rank() OVER ({part}ORDER BY x) + (count(*) OVER (PARTITION BY {pick}x) - 1) / 2 AS rx, rank() OVER ({part}ORDER BY y) + (count(*) OVER (PARTITION BY {pick}y) - 1) / 2 AS ry FROM ptx),
      sm AS (SELECT {pick}count(DISTINCT item_id) AS n_items, count(*) AS n_points, {LINE_SQL.format(k="1")} AS slope, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my,
        (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) ** 2 / ((sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) * (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2)) AS r_squared,
        corr(rx, ry) AS spearman, avg(abs(y - x)) AS error, avg((sign(x) = sign(y))::INT) FILTER (WHERE abs(y) > 1e-8) AS agreement, avg((abs(y) <= 1e-8)::INT) AS tie_rate FROM rk {group})
      SELECT {pick}n_items, n_points, round(slope, 5) AS slope, round(low, 5) AS low, round(high, 5) AS high, round(my - slope * mx, 5) AS intercept, round(r_squared, 5) AS r_squared, round(spearman, 5) AS spearman,
        round(error, 5) AS error, round(agreement, 5) AS agreement, round(tie_rate, 5) AS tie_rate FROM sm JOIN iv {using}"""


UPDATE = ["slope", "low", "high", "intercept", "r_squared", "spearman", "error", "agreement", "tie_rate"]


@query("o100_update_summary", f"WITH {update_sql('')}")
def update_summary(spark, d):
    return rounded(R.update_summary(points(spark, d), [], N), ["n_items", "n_points"], UPDATE, 5)


@query("o101_change_by_label", f"WITH {update_sql('label')} WHERE n_points >= 10")
def change_by_label(spark, d):
    return rounded(R.update_summary(points(spark, d), ["label"], N).filter("n_points >= 10"), ["label", "n_items", "n_points"], UPDATE, 5)


@query("o092_report", f"""WITH {RESP}, e AS ({EFFECT.format(r='', e='')}), {CEILING}, u AS (SELECT case_id AS unit, order_effect AS s, 1 AS n FROM e WHERE order_effect IS NOT NULL), {S.weights_sql("u", "unit", "a1", N)},
    b AS (SELECT r, sum(w * s) / sum(w * n) AS v FROM u JOIN weights USING (unit) GROUP BY 1),
    t AS (SELECT vec_id, label, rn, min_by(i, struct_pack(a := -x, b := i)) AS top, bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64) AS told FROM l GROUP BY 1, 2, 3),
    f AS (SELECT label, count(DISTINCT top) > 1 AS flips FROM t WHERE rn <= 10 GROUP BY 1),
    i AS (SELECT avg(a) AS a FROM (SELECT avg(told::INT) AS a FROM t GROUP BY CASE WHEN rn <= 10 THEN 1 WHEN rn <= 16 THEN 2 WHEN rn <= 18 THEN 3 ELSE 4 END))
    SELECT count(*) AS n_cases, round(avg(jsd_permutation), 6) AS jsd_permutation, round(avg(jsd_retest), 6) AS jsd_retest, round(avg(order_effect), 6) AS order_effect, (SELECT round(quantile_cont(v, 0.025), 6) FROM b) AS low, (SELECT round(quantile_cont(v, 0.975), 6) FROM b) AS high,
      round((SELECT avg(jsd) FROM q), 6) AS ceiling, round(CASE WHEN (SELECT avg(jsd) FROM q) - avg(jsd_retest) > 1e-9 THEN avg(order_effect) / ((SELECT avg(jsd) FROM q) - avg(jsd_retest)) END, 6) AS normalised,
      (SELECT round(avg(flips::INT), 6) FROM f) AS flip_rate, (SELECT round(a, 6) FROM i) AS informative_rate FROM e""")
def order_report(spark, d):
    rows = responses(spark, d)
    rates = rows.groupBy("arm").agg(F.avg(V.informative(F.col("v")).cast("int")).alias("informative_rate"))
    out = R.order_summary(arms.order_effect(rows), arms.case_shape(rows), rates, arms.ceiling(rows).select("ceiling"), N)
    return rounded(out, ["n_cases"], ["jsd_permutation", "jsd_retest", "order_effect", "low", "high", "ceiling", "normalised", "flip_rate", "informative_rate"])


@query("o091_top_overlap", f"""WITH {P20}, k AS (SELECT vec_id, label, i FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS z FROM l WHERE rn <= 10) WHERE z <= 5),
    c AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, count(*) AS n FROM k a JOIN k b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id GROUP BY ALL),
    v AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.rn <= 10 AND b.rn <= 10)
    SELECT v.label AS case_id, count(*) AS n_pairs, round(avg(coalesce(n, 0) / (10 - coalesce(n, 0))), 6) AS top5_jaccard FROM v LEFT JOIN c USING (label, a, b) GROUP BY 1""")
def top_overlap(spark, d):
    return arms.top_overlap(responses(spark, d), 5).select("case_id", "n_pairs", r6(F.col("top5_jaccard")).alias("top5_jaccard"))


@query("o091_informative_only", f"""WITH {RESP}, o AS (SELECT vec_id, bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64) AND vec_id % 3 > 0 AS told FROM l GROUP BY 1), g AS (SELECT pa.* FROM pa JOIN o a ON a.vec_id = a_id AND a.told JOIN o b ON b.vec_id = b_id AND b.told)
    SELECT case_id, round(avg(jsd) FILTER (WHERE a_arm = 'permutation' AND b_arm = 'permutation'), 6) AS jsd_permutation, round(avg(jsd) FILTER (WHERE a_arm = 'retest' AND b_arm = 'retest'), 6) AS jsd_retest FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE a_arm = 'permutation' AND b_arm = 'permutation') > 0""")
def informative_only(spark, d):
    """Every third vector is made uniform: it says nothing and is left out."""
    rows = responses(spark, d)
    even = lambda v: F.transform(v, lambda x: F.lit(1.0) / F.size(v))
    blank = F.when(F.col("vec_id") % 3 == 0, F.get(F.transform(F.array("v"), even), F.lit(0))).otherwise(F.col("v"))  # v is bound once
    out = arms.order_effect(rows.withColumn("v", blank).filter(V.informative(F.col("v"))))
    return out.select("case_id", r6(F.col("jsd_permutation")).alias("jsd_permutation"), r6(F.col("jsd_retest")).alias("jsd_retest"))


@query("o102_summary", f"""WITH {RESP}, h AS (SELECT vec_id, sum(CASE WHEN x > 1e-12 THEN -x * log2(x) ELSE 0 END) AS h, min_by(i, struct_pack(a := -x, b := i)) AS top FROM l GROUP BY 1),
    it AS (SELECT m.jsd, c.jsd AS certified, hb.h - ha.h AS entropy_change, ha.top <> hb.top AS flip FROM pa m JOIN pa c ON c.a_id = m.a_id AND c.b_rn = c.a_rn + 1 JOIN h ha ON ha.vec_id = m.a_id JOIN h hb ON hb.vec_id = m.b_id WHERE m.b_rn = m.a_rn + 10),
    fl AS (SELECT avg(jsd_retest) AS floor FROM ({EFFECT.format(r='', e='')}))
    SELECT count(*) AS n, round(avg(jsd), 6) AS mean, round(median(jsd), 6) AS median, round(quantile_cont(jsd, 0.9), 6) AS p90, round(avg(certified), 6) AS certified, round(max(floor), 6) AS floor, round(avg(jsd) / avg(certified), 6) AS ratio,
      round(avg(jsd) - max(floor), 6) AS excess, round(avg((jsd > floor)::INT), 6) AS share_above, round(avg(flip::INT), 6) AS flip_rate, round(avg(entropy_change), 6) AS entropy_change, round(avg((entropy_change < 0)::INT), 6) AS inflation_rate FROM it, fl""")
def redundancy_summary(spark, d):
    """Items as in o102_redundancy; what stands for the certified change is that to the next place."""
    p = runs(posteriors(spark, d), 20)
    phase = lambda name, at: p.filter("rn <= 10").select(item(at), F.lit(name).alias("phase"), "v")
    item = lambda at: F.concat_ws("|", "case_id", at).alias("item_id")
    later = p.filter("rn > 10").select(item(F.col("rn") - 10), F.lit("with").alias("phase"), "v")
    moved = arms.phase_change(phase("without", F.col("rn")).unionByName(later))
    near = p.filter("rn between 2 and 11").select(item(F.col("rn") - 1), F.lit("with").alias("phase"), "v")
    certified = arms.phase_change(phase("without", F.col("rn")).unionByName(near)).select("item_id", F.col("jsd").alias("certified"))
    floor = arms.order_effect(responses(spark, d)).agg(F.avg("jsd_retest").alias("floor"))
    out = R.redundancy_summary(moved.join(certified, "item_id"), floor)
    return rounded(out, ["n"], ["mean", "median", "p90", "certified", "floor", "ratio", "excess", "share_above", "flip_rate", "entropy_change", "inflation_rate"])


# weights of two kinds, named answers, scoring rules

ABLATION_GRID = [0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0]
ABLATION = f"""SELECT tau, count(*) AS n, avg(nll) AS nll, avg(top1) AS top1, avg(top2) AS top2, avg(entropy) AS entropy FROM ls GROUP BY 1"""


@query("o109_weight_ablation", f"""WITH a AS (WITH {tau_sql(ABLATION_GRID)} {ABLATION}), b AS (WITH {tau_sql(ABLATION_GRID).replace("FROM t JOIN cr w", "FROM t JOIN mr w")} {ABLATION}),
    u AS (SELECT 'counts' AS weights, * FROM a UNION ALL SELECT 'mixture', * FROM (SELECT * FROM b ORDER BY round(nll, 9), tau LIMIT 1))
    SELECT weights, tau, n, round(nll, 5) AS nll, round(top1, 6) AS top1, round(top2, 6) AS top2, round(entropy, 5) AS entropy FROM u""")
def weight_ablation(spark, d):
    """Weights from counts at every scale, and those of the mixture at the scale of their least loss."""
    rows, tokens = frames(spark, d)
    priors = K.prior(rows)
    trace = lambda w: K.scale_trace(K.wide_sums(tokens, w, ["label"]), priors, "label", ABLATION_GRID, top=2)
    best = K.with_fitted(trace(K.mixture_ratio(K.likelihoods(tokens, rows))), [], "best").filter("tau = best").drop("best")
    out = trace(K.count_ratio(tokens, rows)).withColumn("weights", F.lit("counts")).unionByName(best.withColumn("weights", F.lit("mixture")))
    return out.select("weights", "tau", "n", F.round("nll", 5).alias("nll"), r6(F.col("top1")).alias("top1"), r6(F.col("top2")).alias("top2"), F.round("entropy", 5).alias("entropy"))


def rates_sql(hits, by, seed):
    """SQL of S.bootstrap_mean by a column over hits (by, unit, hit): by, mean, low and high."""
    return f"""u AS (SELECT {by}, unit, sum(hit)::DOUBLE AS s, count(*) AS n FROM {hits} GROUP BY ALL), {S.weights_sql("u", "unit", seed, N)}, b AS (SELECT {by}, r, sum(w * s) / sum(w * n) AS v FROM u JOIN weights USING (unit) GROUP BY ALL),
      rt AS (SELECT {by}, mean, low, high FROM (SELECT {by}, sum(s) / sum(n) AS mean FROM u GROUP BY 1) JOIN (SELECT {by}, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM b GROUP BY 1) USING ({by}))"""


@query("o114_named_answers", f"""WITH {P20}, t AS (SELECT vec_id, label, target, min_by(i, struct_pack(a := -x, b := i)) AS top, (vec_id * 7) % 70 AS named FROM l GROUP BY 1, 2, 3),
    h AS (SELECT 'stated' AS kind, label AS unit, (top = target)::INT AS hit FROM t UNION ALL SELECT 'named', label, (named = target)::INT FROM t), {rates_sql('h', 'kind', 'n')},
    k AS (SELECT vec_id, 1 + count(*) FILTER (WHERE x > o) AS rank FROM (SELECT l.vec_id, l.x, n.x AS o FROM l JOIN t USING (vec_id) JOIN l n ON n.vec_id = l.vec_id AND n.i = named) GROUP BY 1)
    SELECT kind, round(mean, 6) AS top1, round(low, 6) AS low, round(high, 6) AS high, round((SELECT mean FROM rt WHERE kind = 'named') - (SELECT mean FROM rt WHERE kind = 'stated'), 6) AS gap, (SELECT median(rank)::DOUBLE FROM k) AS median_rank, (SELECT round(avg((rank = 1)::INT), 6) FROM k) AS first_rate FROM rt""")
def named_answers(spark, d):
    """The named answer is a number that may lie outside the candidates."""
    p = runs(posteriors(spark, d), 20).select("case_id", F.col("label").alias("truth"), "v", ((F.col("vec_id") * 7) % 70).cast("int").alias("named"))
    rows = R.named_ranks(p)
    hits = rows.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_hit").alias("hit")) for k in ("stated", "named")])).alias("z")).select("case_id", "z.*")
    rates = S.bootstrap_mean(hits, "hit", "case_id", N, "n", ["kind"])
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("mean")))
    places = Q.quantiles(rows, [], "rank", {"median_rank": 0.5}).crossJoin(F.broadcast(rows.agg(r6(F.avg((F.col("rank") == 1).cast("int"))).alias("first_rate"))))  # a row each
    gap = rates.agg(r6(of("named") - of("stated")).alias("gap"))
    return rates.crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(places)).select("kind", r6(F.col("mean")).alias("top1"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "gap", "median_rank", "first_rate")


@query("o160_belief_gap", f"""WITH {P20}, t AS (SELECT vec_id, target, min_by(i, struct_pack(a := -x, b := i)) AS top, (vec_id * 7) % 70 AS named, bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64) AND vec_id % 5 > 0 AS told FROM l GROUP BY 1, 2),
    n AS (SELECT count(*) AS n, count(*) FILTER (WHERE top = target AND named <> target) AS x, count(*) FILTER (WHERE top <> target AND named = target) AS y, avg((named = top)::INT) AS ag, avg((named = top)::INT) FILTER (WHERE told) AS ai, avg((NOT told)::INT) AS un, avg((top = target)::INT) FILTER (WHERE told) AS ac FROM t)
    SELECT n, x AS only_stated, y AS only_named, round(ag, 6) AS agreement, round(ai, 6) AS agreement_informative, round(un, 6) AS uniform_share, round(ac, 6) AS accuracy_informative, round(CASE WHEN x + y > 0 THEN (abs(x - y) - 1) ** 2 / (x + y) END, 6) AS chi_squared FROM n""")
def belief_gap(spark, d):
    """Every fifth vector counts as one that says nothing."""
    p = runs(posteriors(spark, d), 20).select(F.col("label").alias("truth"), "v", ((F.col("vec_id") * 7) % 70).cast("int").alias("named"), (V.informative(F.col("v")) & (F.col("vec_id") % 5 > 0)).alias("told"))
    return rounded(R.belief_gap(p), ["n", "only_stated", "only_named"], ["agreement", "agreement_informative", "uniform_share", "accuracy_informative", "chi_squared"])


METHODS = [("direct", 1, 1), ("self_consistency", 11, 16), ("ensemble_2", 1, 2), ("ensemble_3", 1, 3), ("ensemble_5", 1, 5)]


@query("o107_accuracy", f"""WITH {P20}, m(method, lo, hi) AS (VALUES {", ".join(map(str, METHODS))}), ok AS (SELECT label FROM p WHERE rn <= 16 GROUP BY 1 HAVING count(*) = 16),
    v AS (SELECT label, target, method, i, avg(x) AS x FROM l JOIN m ON rn BETWEEN lo AND hi WHERE label IN (SELECT label FROM ok) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY label, method ORDER BY x DESC, i) AS k FROM v),
    c AS (SELECT label, method, max((k = 1)::INT) FILTER (WHERE i = target) AS top1, max((k <= 5)::INT) FILTER (WHERE i = target) AS top5, sum(CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END) AS entropy FROM k GROUP BY 1, 2)
    SELECT method, count(*) AS n_cases, max(hi - lo + 1)::INT AS queries, round(avg(top1), 6) AS top1, round(avg(top5), 6) AS top5, round(avg(entropy), 6) AS entropy FROM c JOIN m USING (method) GROUP BY 1""")
def method_accuracy(spark, d):
    p = runs(posteriors(spark, d), 20)
    method = F.array_compact(F.array(*[F.when(F.col("rn").between(a, b), F.struct(F.lit(k).alias("method"), F.lit(b - a + 1).alias("queries"))) for k, a, b in METHODS]))
    whole = p.filter("rn <= 16").groupBy("case_id").agg(F.count("*").alias("n")).filter("n = 16").select("case_id")
    parts = p.join(whole, "case_id").select("case_id", F.col("label").alias("truth"), "v", F.explode(method).alias("z")).select("case_id", "truth", "z.*", "v")
    means = M.mean_vectors(parts, ["case_id", "truth", "method", "queries"])
    v = F.col("v")
    hit = means.select("method", "queries", (V.top1(v) == F.col("truth")).cast("int").alias("top1"), F.array_contains(V.top_k(v, 5), F.col("truth").cast("int")).cast("int").alias("top5"), V.entropy(v, 0.0).alias("entropy"))
    return rounded(hit.groupBy("method", "queries").agg(F.count("*").alias("n_cases"), F.avg("top1").alias("top1"), F.avg("top5").alias("top5"), F.avg("entropy").alias("entropy")), ["method", "queries", "n_cases"], ["top1", "top5", "entropy"])


@query("o118_entropy_control", f"""WITH {RESP}, e AS ({EFFECT.format(r='', e='')}), h AS (SELECT label, avg(h) AS h FROM (SELECT label, vec_id, sum(CASE WHEN x > 1e-12 THEN -x * log2(x) ELSE 0 END) AS h FROM l WHERE rn <= 10 GROUP BY 1, 2) GROUP BY 1)
    SELECT round(corr(h, jsd_permutation), 6) AS with_permutation, round(corr(h, jsd_retest), 6) AS with_retest, round(corr(h, order_effect), 6) AS with_effect FROM e JOIN h ON label = case_id""")
def entropy_control(spark, d):
    """Whether a case's order effect goes with the entropy of its answers."""
    rows = responses(spark, d)
    both = arms.order_effect(rows).join(arms.case_shape(rows).select("case_id", "mean_entropy"), "case_id")
    return both.agg(*[r6(F.corr("mean_entropy", c)).alias(k) for c, k in (("jsd_permutation", "with_permutation"), ("jsd_retest", "with_retest"), ("order_effect", "with_effect"))])


@query("o113_report", f"""WITH {P20}, ok AS (SELECT label FROM p WHERE rn IN (1, 17, 18) GROUP BY 1 HAVING count(*) = 3), v AS (SELECT label, target, 'canonical' AS kind, i, avg(x) AS x FROM l WHERE rn IN (17, 18) AND label IN (SELECT label FROM ok) GROUP BY ALL UNION ALL SELECT label, target, 'direct', i, x FROM l WHERE rn = 1 AND label IN (SELECT label FROM ok)),
    t AS (SELECT label, target, kind, min_by(i, struct_pack(a := -x, b := i)) AS top FROM v GROUP BY 1, 2, 3), w AS (SELECT label, max(target) AS target, max(top) FILTER (WHERE kind = 'canonical') AS c, max(top) FILTER (WHERE kind = 'direct') AS d FROM t GROUP BY 1),
    h AS (SELECT 'canonical' AS kind, label AS unit, (c = target)::INT AS hit FROM w UNION ALL SELECT 'direct', label, (d = target)::INT FROM w UNION ALL SELECT 'flip', label, (c <> d)::INT FROM w), {rates_sql('h', 'kind', 'cb')}
    SELECT kind, round(mean, 6) AS rate, round(low, 6) AS low, round(high, 6) AS high FROM rt""")
def canonical_report(spark, d):
    pick = lambda k: F.max_by("v", F.when(F.col("method") == k, F.lit(1)))
    rows = responses(spark, d).withColumn("truth", F.split("case_id", r"\|")[0].cast("int"))
    whole = rows.filter("(arm = 'permutation' and idx = 0) or arm = 'canonical'").groupBy("case_id", "truth").agg(F.count("*").alias("n")).filter("n = 3")
    wide = M.named_means(rows).groupBy("case_id").agg(pick("canonical").alias("a"), pick("direct").alias("b")).join(whole, "case_id")
    a, b, t = V.top1(F.col("a")), V.top1(F.col("b")), F.col("truth")
    kinds = {"canonical": a == t, "direct": b == t, "flip": a != b}
    hits = wide.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("int").alias("hit")) for k, c in kinds.items()])).alias("z")).select("case_id", "z.*")
    out = S.bootstrap_mean(hits, "hit", "case_id", N, "cb", ["kind"])
    return out.select("kind", r6(F.col("mean")).alias("rate"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("o121_scoring_rules", f"""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS i FROM embeddings), s AS (SELECT 'sum' AS scoring, vec_id, label, i, x FROM e UNION ALL SELECT 'meanlen', vec_id, label, i, x / (1 + i % 3) FROM e UNION ALL SELECT 'stated', vec_id, label, i, greatest(x, 0) FROM e),
    k AS (SELECT *, row_number() OVER (PARTITION BY scoring, vec_id ORDER BY x DESC, i) AS k FROM s), h AS (SELECT scoring, vec_id % 40 AS unit, (k = 1)::INT AS hit, (k <= 5)::INT AS five FROM k WHERE i = label), {rates_sql('h', 'scoring', 'lp')},
    f AS (SELECT scoring, avg(five) AS five FROM h GROUP BY 1)
    SELECT scoring, round(mean, 6) AS top1, round(low, 6) AS low, round(high, 6) AS high, round(five, 6) AS top5, round(five - mean, 6) AS top5_minus_top1, round(mean / nullif((SELECT mean FROM rt WHERE scoring = 'stated'), 0), 6) AS over_stated FROM rt JOIN f USING (scoring)""")
def scoring_rules(spark, d):
    """Entries as summed log chances, the same divided by a length, and as stated chances."""
    e = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 40).alias("case_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    kinds = {"sum": V.softmax(F.col("e")), "meanlen": V.softmax(F.transform("e", lambda x, i: x / (1 + i % 3))), "stated": V.normalised(F.col("e"))}
    rows = e.select("label", "case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("scoring"), v.alias("v")) for k, v in kinds.items()])).alias("z")).select("label", "case_id", "z.*")
    hits = rows.select("scoring", "case_id", (V.top1(F.col("v")) == F.col("label")).cast("int").alias("hit"), F.array_contains(V.top_k(F.col("v"), 5), F.col("label").cast("int")).cast("int").alias("five"))
    rates = S.bootstrap_mean(hits, "hit", "case_id", N, "lp", ["scoring"]).join(hits.groupBy("scoring").agg(F.avg("five").alias("five")), "scoring")
    stated = rates.filter("scoring = 'stated'").select(F.nullif(F.col("mean"), F.lit(0.0)).alias("base"))
    out = rates.crossJoin(F.broadcast(stated))  # one row
    return out.select("scoring", r6(F.col("mean")).alias("top1"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), r6(F.col("five")).alias("top5"), r6(F.col("five") - F.col("mean")).alias("top5_minus_top1"), r6(F.col("mean") / F.col("base")).alias("over_stated"))


@query("o161_gap_ratio", "WITH g AS (SELECT lang, avg((" + PRED + " = quality)::INT) - 0.5 AS x, avg(((n_chars > 400)::INT = quality)::INT) - 0.5 AS y FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT count(*) AS n, round(sum(x) / nullif(sum(y), 0), 6) AS ratio, round(avg(x / nullif(y, 0)), 6) AS mean_ratio FROM g")
def gap_ratio(spark, d):
    """Two rules' gaps to chance, by language."""
    first, second = F.col("predicted") == F.col("quality"), (F.col("n_chars") > 400).cast("int") == F.col("quality")
    gaps = predictions(spark, d).groupBy("lang").agg((F.avg(first.cast("int")) - 0.5).alias("x"), (F.avg(second.cast("int")) - 0.5).alias("y"))
    return rounded(R.gap_ratio(gaps, "x", "y"), ["n"], ["ratio", "mean_ratio"])


@query("o162_retention", f"""WITH {tau_sql(ABLATION_GRID)}, m AS (SELECT sex, tau, avg(top1) AS a FROM ls JOIN c USING (row_id) GROUP BY 1, 2),
    b AS (SELECT sex, min_by(tau, struct_pack(p := round(-a, 9), q := tau)) AS best_tau, max(a) AS best, max(a) FILTER (WHERE tau = 1.0) AS direct FROM m GROUP BY 1)
    SELECT sex, best_tau, round(best, 6) AS best, round(direct, 6) AS direct, round(best / direct, 6) AS retention, round((SELECT corr(direct, best / direct) FROM b), 5) AS pearson FROM b""")
def retention(spark, d):
    rows, tokens = frames(spark, d)
    cases = tokens.join(rows.select("row_id", "sex"), "row_id")
    out = R.retention(K.scale_trace(K.wide_sums(cases, K.count_ratio(tokens, rows), ["label", "sex"]), K.prior(rows), "label", ABLATION_GRID, ["sex"], top=2), "sex")
    return out.select("sex", "best_tau", *[r6(F.col(c)).alias(c) for c in ("best", "direct", "retention")], F.round("pearson", 5).alias("pearson"))


# the reconstruction against shipped vectors

SHIPPED = f"""{L}, sh AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2), sv AS (SELECT row_id, a.label, coalesce(sh.n, 0) / sum(coalesce(sh.n, 0)) OVER (PARTITION BY row_id) AS x
      FROM c JOIN orders ON o_orderkey = row_id CROSS JOIN (SELECT label FROM nd) a LEFT JOIN sh ON sh.o_custkey = orders.o_custkey AND sh.label = a.label)"""
VALID = f"""{SHIPPED}, nz AS (SELECT t.row_id, lk.label, sum(ln(p)) + max(log_prior) AS g FROM t JOIN lk USING (token) GROUP BY 1, 2), nb AS (SELECT row_id, label, exp(g - max(g) OVER w) / sum(exp(g)) OVER w * exp(max(g) OVER w) AS y FROM nz WINDOW w AS (PARTITION BY row_id)),
  b AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY x DESC, label) AS kx, row_number() OVER (PARTITION BY row_id ORDER BY y DESC, label) AS ky FROM sv JOIN nb USING (row_id, label)),
  vd AS (SELECT row_id, {JSD.replace("a.x", "x").replace("b.x", "y")} AS jsd, max((kx = 1 AND ky = 1)::INT) AS same, count(*) FILTER (WHERE kx <= 2 AND ky <= 2) AS both FROM b GROUP BY 1)"""
NOISE = """lw AS (SELECT l_orderkey, l_linenumber, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS w, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS k FROM lineitem),
  le AS (SELECT l_orderkey, l_linenumber, k, unnest(list_transform(w, lambda x: x / list_sum(w))) AS x, unnest(range(4)) AS i FROM lw),
  noise AS (SELECT avg(jsd) AS floor FROM (SELECT """ + JSD + """ AS jsd FROM le a JOIN le b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.i = b.i AND a.k < b.k GROUP BY a.l_orderkey, a.l_linenumber, a.k, b.k))"""


def shipped(spark, d):
    """row_id and shipped, the labels' shares among the orders of the row's customer."""
    rows, _ = frames(spark, d)
    axis, orders = K.base_scores(K.prior(rows)).select("axis"), table(spark, d, "orders")
    own = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("own"))  # the labels
    n = F.transform("axis", lambda k: F.coalesce(F.try_element_at("own", k), F.lit(0).cast("long")).cast("double"))
    own = own.crossJoin(F.broadcast(axis)).select("o_custkey", V.normalised(n).alias("shipped"))  # one row
    return orders.join(own, "o_custkey").select(F.col("o_orderkey").alias("row_id"), "shipped")


def reconstruction(spark, d):
    rows, tokens = frames(spark, d)
    made = K.wide_bayes(tokens.select("row_id", "token"), K.likelihoods(tokens, rows)).withColumnRenamed("p", "made")
    return R.validation(made.join(shipped(spark, d), "row_id"), 2)


def noise(spark, d):
    """One row, floor: mean JSD between replicates of a line."""
    w = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    return Q.replicate_noise(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], V.normalised(w)).select(F.col("mean_jsd").alias("floor"))


@query("o078_validation", f"WITH {VALID} SELECT count(*) AS n, round(avg(jsd), 5) AS jsd_mean, round(median(jsd), 5) AS jsd_median, round(quantile_cont(jsd, 0.9), 5) AS jsd_p90, round(avg(same), 5) AS top1_agreement, round(avg(\"both\" / (4 - \"both\")), 5) AS top_k_jaccard FROM vd")
def validation(spark, d):
    return rounded(reconstruction(spark, d), ["n"], ["jsd_mean", "jsd_median", "jsd_p90", "top1_agreement", "top_k_jaccard"], 5)


@query("o080_regime", f"WITH {VALID}, {NOISE} SELECT round(floor, 6) AS floor, CASE WHEN (SELECT avg(jsd) FROM vd) <= floor THEN 'ABSOLUTE' ELSE 'RELATIVE' END AS regime FROM noise")
def regime(spark, d):
    both = reconstruction(spark, d).crossJoin(F.broadcast(noise(spark, d)))  # a row each
    return both.select(r6(F.col("floor")).alias("floor"), R.regime(F.col("jsd_mean"), F.col("floor")).alias("regime"))


PHI = f"""oc AS (SELECT label, token, count(*) AS c FROM t GROUP BY 1, 2), gp AS (SELECT x.label, x.token AS a, y.token AS b, x.c::DOUBLE AS ca, y.c::DOUBLE AS cb, n_d::DOUBLE AS m FROM oc x JOIN oc y ON x.label = y.label AND x.token < y.token JOIN nd ON nd.label = x.label WHERE x.c BETWEEN 20 AND n_d - 20 AND y.c BETWEEN 20 AND n_d - 20),
  np AS (SELECT x.label, x.token AS a, y.token AS b, count(*) AS k FROM t x JOIN t y ON x.row_id = y.row_id AND x.token < y.token GROUP BY 1, 2, 3), ph AS (SELECT abs((coalesce(k, 0) * m - ca * cb) / sqrt(ca * cb * (m - ca) * (m - cb))) AS phi FROM gp LEFT JOIN np USING (label, a, b))"""


def independence(spark, d):
    rows, tokens = frames(spark, d)
    phi = F.abs("phi")
    return K.token_pairs(tokens, rows, 20).agg(F.avg(phi).alias("phi_mean"), F.avg((phi > 0.1).cast("int")).alias("phi_share"))


@query("o141_reconstruction", f"""WITH {VALID}, {NOISE}, {PHI}, v AS (SELECT avg(jsd) AS j, avg(same) AS s FROM vd), f AS (SELECT avg(phi) AS p, avg((phi > 0.1)::INT) AS h FROM ph)
    SELECT 'naive_bayes_reconstruction' AS "check", CASE WHEN j <= floor THEN 'info' ELSE 'major' END AS severity, round(j, 5) AS jsd_mean, round(s, 5) AS top1_agreement, round(floor, 5) AS floor, round(p, 5) AS phi_mean, round(h, 5) AS phi_share FROM v, noise, f""")
def reconstruction_check(spark, d):
    both = reconstruction(spark, d).crossJoin(F.broadcast(noise(spark, d))).crossJoin(F.broadcast(independence(spark, d)))  # a row each
    level = F.when(F.col("jsd_mean") <= F.col("floor"), "info").otherwise("major")
    return both.select(F.lit("naive_bayes_reconstruction").alias("check"), level.alias("severity"), *[F.round(c, 5).alias(c) for c in ("jsd_mean", "top1_agreement", "floor", "phi_mean", "phi_share")])


@query("o143_oracle_vs_shipped", f"""WITH {SHIPPED}, o AS (SELECT row_id, list(token ORDER BY md5(row_id || '|' || token), token) AS ts FROM t GROUP BY 1), e AS (SELECT row_id, list_sort(ts[1:3]) AS ev FROM o WHERE len(ts) >= 3), f AS (SELECT DISTINCT ev FROM e), u AS (SELECT ev, unnest(ev) AS token FROM f),
    h AS (SELECT ev, t.row_id, t.label FROM u JOIN t USING (token) GROUP BY ALL HAVING count(*) = 3), k AS (SELECT ev, label, count(*) AS n FROM h GROUP BY 1, 2), s AS (SELECT ev, sum(n)::BIGINT AS support FROM k GROUP BY 1 HAVING sum(n) >= 25),
    j AS (SELECT row_id, max(support) AS support, {JSD.replace("a.x", "x").replace("b.x", "y")} AS jsd FROM (SELECT sv.row_id, support, x, coalesce(n, 0) / support AS y FROM e JOIN s USING (ev) JOIN sv USING (row_id) LEFT JOIN k ON k.ev = e.ev AND k.label = sv.label) GROUP BY 1)
    SELECT count(*) AS n, round(avg(jsd), 5) AS jsd_mean, round(median(jsd), 5) AS jsd_median, median(support)::DOUBLE AS median_support FROM j""")
def oracle_vs_shipped(spark, d):
    """Rows with equal subsets share one look-up. At least 25 rows, since the given tables are small. The subsets and the
    divergences with their numbers are kept, since what follows reads them several times."""
    rows, tokens = frames(spark, d)
    drawn = kept(M.drawn_subsets(tokens, [3], rows=rows).select("row_id", F.col("evidence").alias("item_id")))
    items = drawn.select("item_id").distinct().withColumn("evidence", F.col("item_id"))
    q = K.wide_conditioned(items, tokens, rows).filter("support >= 25").withColumnRenamed("p", "made")
    both = drawn.join(shipped(spark, d), "row_id").join(q, "item_id")
    j = kept(both.groupBy("support", V.jsd(F.col("made"), F.col("shipped")).alias("jsd")).agg(F.count("*").alias("k")))
    mean = F.sum(F.col("jsd") * F.col("k")) / F.nullif(F.sum("k"), F.lit(0))
    out = j.agg(F.coalesce(F.sum("k"), F.lit(0).cast("long")).alias("n"), mean.alias("jsd_mean"))
    both_values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("jsd", "support")])).alias("z")
    medians = Q.quantiles(j.select("k", both_values).select("k", "z.*"), ["name"], "value", {"median": 0.5}, "k")
    of = lambda c, name: F.max(F.when(F.col("name") == c, F.col("median"))).alias(name)
    out = out.crossJoin(F.broadcast(medians.agg(of("jsd", "jsd_median"), of("support", "median_support"))))  # a row each
    return out.select("n", F.round("jsd_mean", 5).alias("jsd_mean"), F.round("jsd_median", 5).alias("jsd_median"), "median_support")


LINES = "[l_quantity::DOUBLE, l_extendedprice / 1000, l_discount * 100, l_tax * 100, (l_suppkey % 50)::DOUBLE]"
FOLD_SQL = "(('0x' || substr(sha1(row_id::VARCHAR), 1, 1))::INT % 2)::INT"


@query("o107_methods", f"""WITH {tau_sql(ABLATION_GRID)}, {SHIPPED.removeprefix(L + ", ")},
    bt AS (SELECT 1 - fold AS fold, min_by(tau, struct_pack(a := round(nll, 9), b := tau)) AS tau FROM (SELECT {FOLD_SQL} AS fold, tau, avg(nll) AS nll FROM ls GROUP BY 1, 2) GROUP BY 1),
    li AS (SELECT l_orderkey AS row_id, {LINES} AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS n FROM lineitem),
    le AS (SELECT row_id, n, unnest(list_transform(w, lambda x: x / list_sum(w))) AS x, unnest(range(5)) AS i FROM li WHERE n <= 7),
    mh(method, half, lo, hi) AS (VALUES ('direct', 0, 1, 1), ('direct', 1, 2, 2), ('self_consistency', 0, 5, 5), ('self_consistency', 1, 6, 6), ('self_consistency', 2, 5, 7), ('ensemble_2', 0, 1, 2), ('ensemble_2', 1, 3, 4)),
    ok AS (SELECT row_id, max(n) AS n FROM li GROUP BY 1 HAVING max(n) >= 6),
    hv AS (SELECT row_id, method, half, i, avg(x) AS x FROM le JOIN mh ON n BETWEEN lo AND hi WHERE row_id IN (SELECT row_id FROM ok) GROUP BY ALL),
    rs AS (SELECT a.row_id, a.method, {JSD} AS residual FROM hv a JOIN hv b ON a.row_id = b.row_id AND a.method = b.method AND a.i = b.i AND a.half = 0 AND b.half = 1 GROUP BY 1, 2),
    ax AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM pr),
    fu AS (SELECT row_id, label, method, ln(greatest(p, 1e-9)) + z.tau * s AS z FROM es JOIN pr USING (label) JOIN (SELECT row_id, method, CASE WHEN method = 'fusion' THEN 1.0::DOUBLE ELSE bt.tau END AS tau FROM c JOIN bt ON bt.fold = {FOLD_SQL}, (VALUES ('fusion'), ('fusion_calibrated')) q(method)) z USING (row_id)),
    ev AS (SELECT row_id, list(token ORDER BY token) AS ev FROM t GROUP BY 1), sb AS (SELECT label, list_filter(ev, lambda x, i: (m >> (i - 1)) & 1 = 1) AS ev FROM (SELECT label, ev, unnest(range(1, 1 << len(ev))) AS m FROM ev JOIN c USING (row_id))),
    oc AS (SELECT ev, label, count(*) AS n FROM sb WHERE ev IN (SELECT ev FROM ev) GROUP BY 1, 2), oq AS (SELECT ev, sum(n) AS n FROM oc GROUP BY 1),
    mt AS (SELECT row_id, method, i, x FROM hv WHERE half = CASE WHEN method = 'self_consistency' THEN 2 ELSE 0 END
      UNION ALL SELECT row_id, method, i, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) FROM fu JOIN ax USING (label) WINDOW w AS (PARTITION BY row_id, method)
      UNION ALL SELECT row_id, 'prior_only', i, p FROM c CROSS JOIN pr JOIN ax ON ax.label = pr.label
      UNION ALL SELECT row_id, 'oracle', i, coalesce(oc.n, 0) / oq.n FROM ev JOIN oq USING (ev) CROSS JOIN ax LEFT JOIN oc ON oc.ev = ev.ev AND oc.label = ax.label),
    rk2 AS (SELECT mt.*, row_number() OVER (PARTITION BY mt.row_id, method ORDER BY x DESC, i) AS k FROM mt WHERE mt.row_id IN (SELECT row_id FROM ok)),
    js AS (SELECT rk2.row_id, method, {JSD.replace("a.x", "rk2.x").replace("b.x", "sv.x")} AS jsd, sum(CASE WHEN rk2.x > 0 THEN -rk2.x * log2(rk2.x) ELSE 0 END) AS entropy, max((k = 1 AND ax.label = c.label)::INT) AS top1, max((k <= 2 AND ax.label = c.label)::INT) AS top2
      FROM rk2 JOIN ax USING (i) JOIN sv ON sv.row_id = rk2.row_id AND sv.label = ax.label JOIN c ON c.row_id = rk2.row_id GROUP BY 1, 2)
    SELECT method, count(*) AS n_cases, round(avg(coalesce(residual, 0)), 5) AS residual, CASE WHEN method IN ('direct', 'self_consistency') THEN 'no' WHEN method LIKE 'ensemble%' THEN 'approx' ELSE 'exact' END AS order_invariant,
      max(CASE method WHEN 'direct' THEN 1 WHEN 'ensemble_2' THEN 2 WHEN 'self_consistency' THEN least(ok.n, 7) - 4 ELSE 0 END)::INT AS queries, method LIKE 'fusion%' AS auditable,
      round(avg(top1), 6) AS top1, round(avg(top2), 6) AS top2, round(avg(jsd), 5) AS jsd_to_shipped, round(avg(entropy), 5) AS entropy FROM js JOIN ok USING (row_id) LEFT JOIN rs USING (row_id, method) GROUP BY 1""")
def methods(spark, d):
    """Answers from an order's lines (four permutations, up to three retests), fused ones, the prior and the data's own
    posterior, beside the shares of the customer's orders. Cases are orders that all of them answer."""
    rows, tokens = frames(spark, d)
    weights, priors = K.count_ratio(tokens, rows), K.prior(rows)
    w = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100, (F.col("l_suppkey") % 50).cast("double"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))  # the lines of an order
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), line.alias("n"), V.normalised(w).alias("v")).filter("n <= 7")
    answers = M.elicited_methods(lines.select("case_id", F.when(F.col("n") <= 4, "permutation").otherwise("retest").alias("arm"), F.col("n").alias("idx"), "v"), [2])
    fold = F.conv(F.substring(F.sha1(F.col("row_id").cast("string")), 1, 1), 16, 10).cast("int") % 2
    sums = K.wide_sums(tokens.withColumn("fold", fold), weights, ["label", "fold"])
    scales = K.with_fitted(K.scale_trace(sums, priors, "label", ABLATION_GRID, ["fold"], top=2), ["fold"], "best").select("fold", "best").distinct()
    fused = M.fused_methods(sums, priors, scales, F.col("fold"))
    base = K.base_scores(priors)
    floor = rows.select("row_id").crossJoin(F.broadcast(base)).select("row_id", F.lit("prior_only").alias("method"), F.transform("base", F.exp).alias("v"))  # one row
    own = rows.select("row_id", F.array_join("tokens", "|").alias("item_id"), F.col("tokens").alias("evidence"))
    known = K.conditioned(own.select("item_id", "evidence").distinct(), tokens, rows).groupBy("item_id").agg(K.in_order(F.col("p")).alias("v"))
    ceiling = own.join(known, "item_id").select("row_id", F.lit("oracle").alias("method"), "v")
    free = fused.unionByName(floor).unionByName(ceiling).select(F.col("row_id").alias("case_id"), "method", "v", F.lit(0.0).alias("residual"), F.lit(0).alias("queries"))
    truth = rows.select("row_id", "label").crossJoin(F.broadcast(base)).select("row_id", (F.array_position("axis", F.col("label")) - 1).cast("int").alias("truth"))  # one row
    cases = truth.join(shipped(spark, d), "row_id").withColumnRenamed("row_id", "case_id")
    out = M.method_table(answers.unionByName(free), cases, top=2)
    return out.select("method", "n_cases", "order_invariant", "queries", "auditable", *[F.round(c, 5).alias(c) for c in ("residual", "jsd_to_shipped", "entropy")], r6(F.col("top1")).alias("top1"), r6(F.col("top2")).alias("top2"))


@query("o144_findings", f"""WITH {VALID}, {NOISE}, f("check", severity, headline) AS (
    SELECT 'duplicates', 'minor', 'texts beyond the first: ' || sum(n - 1) FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)
    UNION ALL SELECT 'class_balance', 'info', 'labels: ' || count(*) FROM nd
    UNION ALL SELECT 'schema_and_nulls', 'info', 'nulls: ' || (count(*) FILTER (WHERE text IS NULL)) FROM documents
    UNION ALL SELECT 'design_decision', CASE WHEN (SELECT avg(jsd) FROM vd) <= floor THEN 'info' ELSE 'major' END, CASE WHEN (SELECT avg(jsd) FROM vd) <= floor THEN 'ABSOLUTE' ELSE 'RELATIVE' END FROM noise)
    SELECT "check", severity, headline, list_position(['critical', 'major', 'minor', 'info'], severity)::INT AS rank FROM f""")
def findings(spark, d):
    docs, (rows, _) = table(spark, d, "documents"), frames(spark, d)
    says = lambda text, c: F.concat(F.lit(text), F.col(c).cast("string"))
    both = reconstruction(spark, d).crossJoin(F.broadcast(noise(spark, d)))  # a row each
    word = R.regime(F.col("jsd_mean"), F.col("floor"))
    return R.assembled([
        R.finding("duplicates", Q.duplicates(docs, F.sha2("text", 256), F.col("source")), "minor", says("texts beyond the first: ", "n_beyond")),
        R.finding("class_balance", rows.select("label").distinct().agg(F.count("*").alias("n")), "info", says("labels: ", "n")),
        R.finding("schema_and_nulls", docs.agg(F.count_if(F.col("text").isNull()).alias("n")), "info", says("nulls: ", "n")),
        R.finding("design_decision", both, F.when(word == "ABSOLUTE", "info").otherwise("major"), word),
    ])


@query("o088_invariance", f"""WITH {L}, w AS (SELECT row_id, cr.label, list(least(greatest(log_ratio, -7), 7) ORDER BY token) AS w FROM t JOIN cr USING (token) GROUP BY 1, 2), s AS (SELECT row_id, label, ln(greatest(p, 1e-9)) + list_sum(w) AS a, ln(greatest(p, 1e-9)) + list_sum(list_reverse(w)) AS b FROM w JOIN pr USING (label)),
    q AS (SELECT row_id, exp(a) / sum(exp(a)) OVER (PARTITION BY row_id) AS x, exp(b) / sum(exp(b)) OVER (PARTITION BY row_id) AS y FROM s), m AS (SELECT row_id, {JSD.replace("a.x", "x").replace("b.x", "y")} AS jsd, max(abs(x - y)) AS far FROM q GROUP BY 1)
    SELECT count(*) AS n, round(avg(jsd), 9) AS mean_jsd, round(max(far), 9) AS max_deviation FROM m""")
def invariance(spark, d):
    rows, tokens = frames(spark, d)
    out = K.invariance(tokens.select("row_id", "token"), K.count_ratio(tokens, rows), K.prior(rows), 3)
    return out.agg(F.count("*").alias("n"), F.round(F.avg("mean_jsd"), 9).alias("mean_jsd"), F.round(F.max("max_deviation"), 9).alias("max_deviation"))


# items of a battery

ARMS_SQL = f"""{C}, h AS (SELECT row_id, j, token, sha1('p|' || row_id || '|' || j || '|' || token) AS h FROM t, range(3) r(j)), o AS (SELECT row_id, j, string_agg(token, ',' ORDER BY h) AS o FROM h GROUP BY 1, 2), k AS (SELECT row_id, string_agg(token, ',' ORDER BY token) AS k, count(*) AS n FROM t GROUP BY 1),
  f AS (SELECT row_id, o, min(j) AS j FROM o JOIN k USING (row_id) WHERE o <> k GROUP BY 1, 2), g AS (SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY j) - 1)::INT AS perm_index, o FROM f UNION ALL SELECT row_id, 0, k FROM k WHERE row_id NOT IN (SELECT row_id FROM f)),
  vo AS (SELECT token, sum(n) OVER w - n AS low, sum(n) OVER w AS high FROM (SELECT token, count(*) AS n FROM t GROUP BY 1) WINDOW w AS (ORDER BY substr(sha1(token), 1, 3), token)),
  tr AS (SELECT row_id, n, i, CASE WHEN i < 2 * n + 16 THEN ('0x' || substr(sha1('x|' || row_id || '|0|' || i), 1, 13))::BIGINT % (SELECT count(*) FROM t) ELSE i - 2 * n - 16 END AS u FROM (SELECT row_id, n, unnest(range(3 * n + 16)) AS i FROM k)),
  sl AS (SELECT row_id, n, u, row_number() OVER (PARTITION BY row_id ORDER BY min(i)) AS i FROM tr GROUP BY row_id, n, u QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY min(i)) <= n),
  arms(row_id, arm, perm_index, replicate, evidence_order) AS (SELECT row_id, 'permutation', perm_index, 0, o FROM g UNION ALL SELECT row_id, 'retest', 0, r::INT, o FROM g, range(2) z(r) WHERE perm_index = 0 UNION ALL SELECT row_id, 'canonical', 0, r::INT, k FROM k, range(2) z(r)
    UNION ALL SELECT row_id, 'shuffled', 0, 0, string_agg(token, ',' ORDER BY i) FROM sl JOIN vo ON u >= low AND u < high GROUP BY 1)"""


def all_arms(spark, d):
    rows, tokens = frames(spark, d)
    return B.arms(rows.select("row_id", "tokens"), tokens, "row_id", permutations=3, retests=2, canonical=2, shuffled=1)


@query("o146_arms", f"WITH {ARMS_SQL} SELECT * FROM arms")
def battery_arms(spark, d):
    return all_arms(spark, d).withColumn("evidence_order", F.array_join("evidence_order", ","))


@query("o151_narrated", f"""WITH {ARMS_SQL}, nt(row_id, arm, perm_index, replicate, evidence_order) AS (
      SELECT row_id, 'permutation', 0, 0, k FROM k UNION ALL SELECT row_id, 'permutation', perm_index + 1, 0, o FROM g JOIN k USING (row_id) WHERE o <> k
      UNION ALL SELECT row_id, 'retest', 0, r::INT, k FROM k, range(2) z(r) UNION ALL SELECT * FROM arms WHERE arm = 'shuffled') SELECT * FROM nt""")
def narrated_arms(spark, d):
    rows, tokens = frames(spark, d)
    out = B.narrated(rows.select("row_id", "tokens"), tokens, "row_id", permutations=4, retests=2, shuffled=1)
    return out.withColumn("evidence_order", F.array_join("evidence_order", ","))


@query("o150_meta", f"WITH {ARMS_SQL} SELECT arm AS kind, count(*) AS n FROM arms GROUP BY 1 UNION ALL SELECT 'cases', count(*) FROM c")
def battery_meta(spark, d):
    rows, _ = frames(spark, d)
    return all_arms(spark, d).groupBy(F.col("arm").alias("kind")).agg(F.count("*").alias("n")).unionByName(rows.agg(F.count("*").alias("n")).select(F.lit("cases").alias("kind"), "n"))


DRAWN = f"""{C}, nl AS (SELECT label, count(*) AS n_d FROM c GROUP BY 1), o AS (SELECT row_id, list(token ORDER BY md5(row_id || '|' || token), token) AS ts FROM t GROUP BY 1),
  dk AS (SELECT row_id, ts, [1, 2][floor(('0x' || substr(sha1('k|' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 2)::INT + 1] AS k FROM o), dr AS (SELECT row_id, list_sort(ts[1:k]) AS ctx, ts[k + 1] AS new FROM dk WHERE len(ts) > k)"""


@query("o147_update_items", f"""WITH {DRAWN}, it AS (SELECT DISTINCT ctx, new FROM dr), ev AS (SELECT DISTINCT ev FROM (SELECT ctx AS ev FROM it UNION ALL SELECT list_sort(list_append(ctx, new)) FROM it)), u AS (SELECT ev, unnest(ev) AS token FROM ev),
    h AS (SELECT ev, t.row_id, t.label FROM u JOIN t USING (token) GROUP BY ALL HAVING count(*) = len(ev)), k AS (SELECT ev, label, count(*) AS n FROM h GROUP BY 1, 2), s AS (SELECT ev, sum(n)::BIGINT AS support FROM k GROUP BY 1 HAVING sum(n) >= 100),
    q AS (SELECT s.ev, nl.label, support, coalesce(n, 0) / support AS p FROM s CROSS JOIN nl LEFT JOIN k ON k.ev = s.ev AND k.label = nl.label), lo AS (SELECT *, ln(least(greatest(p, 1e-4), 1 - 1e-4) / (1 - least(greatest(p, 1e-4), 1 - 1e-4))) AS lo FROM q)
    SELECT array_to_string(ctx, '|') || '>' || new AS item_id, a.label, b.support AS support_before, a.support AS support_after, round(a.lo - b.lo, 6) AS delta FROM it JOIN lo b ON b.ev = ctx JOIN lo a ON a.ev = list_sort(list_append(ctx, new)) AND a.label = b.label""")
def update_items(spark, d):
    rows, tokens = frames(spark, d)
    return B.update_items(tokens, rows, [1, 2], 100).select("item_id", "label", "support_before", "support_after", r6(F.col("delta")).alias("delta"))


REDUNDANT = """u AS (SELECT ev, unnest(ev) AS token FROM ev), h AS (SELECT ev, t.row_id, t.label FROM u JOIN t USING (token) GROUP BY ALL HAVING count(*) = len(ev)), k AS (SELECT ev, label, count(*) AS n FROM h GROUP BY 1, 2), s AS (SELECT ev, sum(n)::BIGINT AS support FROM k GROUP BY 1 HAVING sum(n) >= {least}),
  q AS (SELECT s.ev, nl.label, coalesce(n, 0) / support AS y FROM s CROSS JOIN nl LEFT JOIN k ON k.ev = s.ev AND k.label = nl.label),
  w AS (SELECT ev, h.label, t.token, count(*) AS n FROM h JOIN t USING (row_id) WHERE NOT list_contains(ev, t.token) GROUP BY ALL), wf AS (SELECT x.ev, x.token, q.label, y, coalesce(w.n, 0) AS n FROM (SELECT DISTINCT ev, token FROM w) x JOIN q ON q.ev = x.ev LEFT JOIN w ON w.ev = x.ev AND w.token = x.token AND w.label = q.label),
  wx AS (SELECT *, sum(n) OVER (PARTITION BY ev, token)::BIGINT AS support, n / sum(n) OVER (PARTITION BY ev, token) AS x FROM wf),
  wj AS (SELECT ev, token, max(support) AS support, sum(CASE WHEN x > 1e-12 THEN x * log2(x / ((x + y) / 2)) / 2 ELSE 0 END + CASE WHEN y > 1e-12 THEN y * log2(y / ((x + y) / 2)) / 2 ELSE 0 END) AS jsd FROM wx GROUP BY 1, 2 HAVING max(support) >= {least}),
  rd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ev ORDER BY round(jsd, 9), token) AS z FROM wj WHERE jsd <= {most}) WHERE z <= {each})"""


@query("o148_redundancy_items", f"WITH {DRAWN}, ev AS (SELECT DISTINCT ctx AS ev FROM dr), {REDUNDANT.format(least=100, most=0.004, each=3)} SELECT array_to_string(ev, '|') AS context, token, support, round(jsd, 6) AS jsd FROM rd")
def redundancy_items(spark, d):
    rows, tokens = frames(spark, d)
    return B.redundancy_items(tokens, rows, [1, 2], 100, 0.004).select("context", "token", "support", r6(F.col("jsd")).alias("jsd"))


@query("o154_distractors", f"""WITH {L}, nl AS (SELECT label, n_d FROM nd), ca AS (SELECT row_id, list(token ORDER BY token) AS ts FROM t GROUP BY 1 HAVING count(*) >= 2), ev AS (SELECT DISTINCT ts[1:2] AS ev FROM ca), {REDUNDANT.format(least=20, most=0.02, each=40)},
    sa AS (SELECT token, round(max(abs(log_ratio)), 9) AS sal FROM mr GROUP BY 1) SELECT row_id, min_by(token, struct_pack(a := -sal, b := token)) AS token FROM ca JOIN rd ON rd.ev = ca.ts[1:2] JOIN sa USING (token) WHERE NOT list_contains(ts, token) GROUP BY 1""")
def distractors(spark, d):
    rows, tokens = frames(spark, d)
    return B.distractors(rows, tokens, rows, K.mixture_ratio(K.likelihoods(tokens, rows)), 2, 20, 0.02)


@query("o157_arity", "WITH n AS (SELECT conv_id, count(DISTINCT role) AS n, count(*) AS k FROM conversations GROUP BY 1) SELECT conv_id // 120 AS chunk, n::BIGINT AS n_candidates, count(*) AS n_cases, sum(k)::BIGINT AS n_rows FROM n GROUP BY 1, 2")
def arity(spark, d):
    """Cases of a chunk of 120, put together by the number of their candidates."""
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("n_candidates"), F.count("*").alias("k"))
    return n.groupBy(F.expr("conv_id div 120").alias("chunk"), "n_candidates").agg(F.count("*").alias("n_cases"), F.sum("k").alias("n_rows"))
