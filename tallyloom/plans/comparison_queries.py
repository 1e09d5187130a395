"""Comparison of methods over arms of embeddings, and of changes over orders and the brands of their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import arms, comparison as M, conditioning as K, figures
from tallyloom.operators.kept import kept
from tallyloom.plans.bindings import ARMS, C, JSD, P20, query, r6, responses, table
from tallyloom.plans.corpus_queries import COND, L, conditioned, frames
from tallyloom.plans.vector_queries import EFFECT, RESP

_FIRST = {arm: first for arm, first, _ in ARMS}
_HALVES = ", ".join(f"('{m}', {h}, {_FIRST[arm] + a}, {_FIRST[arm] + b})" for m, h, arm, a, b in M.HALVES)
MEANS = "nm(method, lo, hi) AS (VALUES ('direct', 1, 1), ('single', 11, 11), ('self_consistency', 11, 16), ('ensemble', 1, 10), ('canonical', 17, 18)), mv AS (SELECT label, method, i, avg(x) AS x FROM l JOIN nm ON rn BETWEEN lo AND hi GROUP BY ALL)"


@query("o105_baselines", f"""WITH {P20}, {MEANS} SELECT label AS case_id, method, round(sum(CASE WHEN x > 1e-12 THEN -x * log2(x) ELSE 0 END), 6) AS entropy, round(max(x), 6) AS largest
    FROM mv WHERE method <> 'single' GROUP BY 1, 2""")
def baselines(spark, d):
    v = F.col("v")
    return M.named_means(responses(spark, d)).select("case_id", "method", r6(V.entropy(v)).alias("entropy"), r6(F.array_max(v)).alias("largest"))


@query("o106_ensemble_curve", f"""WITH {P20}, o AS (SELECT label, vec_id, draw, row_number() OVER (PARTITION BY label, draw ORDER BY md5(draw || '|' || vec_id), vec_id) AS place FROM p, range(1, 21) z(draw) WHERE rn <= 10),
    n AS (SELECT label, count(*) AS n FROM p WHERE rn <= 10 GROUP BY 1),
    h AS (SELECT label, draw, vec_id, k, (place > k)::INT AS half FROM o JOIN n USING (label), (VALUES (1), (2), (3), (5)) y(k) WHERE place <= 2 * k AND 2 * k <= n.n),
    m AS (SELECT h.label, draw, k, half, i, avg(x) AS x FROM h JOIN l USING (vec_id) GROUP BY ALL),
    q AS (SELECT a.label, a.draw, a.k, {JSD} AS jsd FROM m a JOIN m b ON a.label = b.label AND a.draw = b.draw AND a.k = b.k AND a.i = b.i AND a.half = 0 AND b.half = 1 GROUP BY ALL)
    SELECT k::INT AS k, count(*) AS n, round(avg(jsd), 6) AS residual FROM q GROUP BY 1""")
def ensemble_curve(spark, d):
    return M.ensemble_curve(responses(spark, d), [1, 2, 3, 5], 20).groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("jsd")).alias("residual"))


@query("o125_root_reference", f"""WITH {P20}, o AS (SELECT label, vec_id, draw, row_number() OVER (PARTITION BY label, draw ORDER BY md5(draw || '|' || vec_id), vec_id) AS place FROM p, range(1, 21) z(draw) WHERE rn <= 10),
    n AS (SELECT label, count(*) AS n FROM p WHERE rn <= 10 GROUP BY 1),
    h AS (SELECT label, draw, vec_id, k, (place > k)::INT AS half FROM o JOIN n USING (label), (VALUES (1), (2), (3), (5)) y(k) WHERE place <= 2 * k AND 2 * k <= n.n),
    m AS (SELECT h.label, draw, k, half, i, avg(x) AS x FROM h JOIN l USING (vec_id) GROUP BY ALL),
    q AS (SELECT a.label, a.draw, a.k, {JSD} AS jsd FROM m a JOIN m b ON a.label = b.label AND a.draw = b.draw AND a.k = b.k AND a.i = b.i AND a.half = 0 AND b.half = 1 GROUP BY ALL),
    c AS (SELECT k::INT AS k, avg(jsd) AS residual FROM q GROUP BY 1), f AS (SELECT k AS k1, residual AS r1 FROM c ORDER BY k LIMIT 1)
    SELECT k, round(residual, 6) AS residual, round(r1 * sqrt(k1 / k), 6) AS reference, round(residual / (r1 * sqrt(k1 / k)), 6) AS ratio FROM c, f""")
def root_reference(spark, d):
    curve = M.ensemble_curve(responses(spark, d), [1, 2, 3, 5], 20).groupBy("k").agg(F.avg("jsd").alias("residual"))
    return figures.root_reference(curve).select("k", *[r6(F.col(c)).alias(c) for c in ("residual", "reference", "ratio")])


@query("o107_method_table", f"""WITH {P20}, mh(method, half, lo, hi) AS (VALUES {_HALVES}), ok AS (SELECT label FROM p WHERE rn <= 16 GROUP BY 1 HAVING count(*) = 16),
    mv AS (SELECT label, method, half, i, avg(x) AS x FROM l JOIN mh ON rn BETWEEN lo AND hi WHERE label IN (SELECT label FROM ok) GROUP BY ALL),
    q AS (SELECT a.label, a.method, {JSD} AS jsd FROM mv a JOIN mv b ON a.label = b.label AND a.method = b.method AND a.i = b.i AND a.half = 0 AND b.half = 1 GROUP BY ALL)
    SELECT method, count(*) AS n_cases, round(avg(jsd), 6) AS residual, round(median(jsd), 6) AS median_residual FROM q GROUP BY 1""")
def method_table(spark, d):
    return M.residuals(responses(spark, d)).groupBy("method").agg(F.count("*").alias("n_cases"), r6(F.avg("jsd")).alias("residual"), r6(F.median("jsd")).alias("median_residual"))


@query("o113_canonical_baseline", f"""WITH {P20}, {MEANS} SELECT a.label AS case_id, round({JSD}, 6) AS jsd,
    min_by(a.i, struct_pack(p := -a.x, q := a.i)) <> min_by(b.i, struct_pack(p := -b.x, q := b.i)) AS flip FROM mv a JOIN mv b ON a.label = b.label AND a.i = b.i AND a.method = 'canonical' AND b.method = 'direct' GROUP BY 1""")
def canonical_baseline(spark, d):
    pick = lambda k: F.max_by("v", F.when(F.col("method") == k, F.lit(1)))
    wide = M.named_means(responses(spark, d)).groupBy("case_id").agg(pick("canonical").alias("a"), pick("direct").alias("b")).filter("a is not null and b is not null")
    return wide.select("case_id", r6(V.jsd(F.col("a"), F.col("b"))).alias("jsd"), (V.top1(F.col("a")) != V.top1(F.col("b"))).alias("flip"))


@query("o115_averaging_gain", f"""WITH {P20}, {MEANS}, q AS (SELECT a.label, a.method, {JSD} AS jsd FROM mv a JOIN mv b ON a.label = b.label AND a.i = b.i AND b.method = 'ensemble' WHERE a.method IN ('single', 'self_consistency') GROUP BY ALL)
    SELECT u.label AS case_id, round(u.jsd, 6) AS single, round(w.jsd, 6) AS averaged, round(u.jsd - w.jsd, 6) AS gain FROM q u JOIN q w ON u.label = w.label AND u.method = 'single' AND w.method = 'self_consistency'""")
def averaging_gain(spark, d):
    return M.averaging_gain(responses(spark, d)).select("case_id", *[r6(F.col(c)).alias(c) for c in ("single", "averaged", "gain")])


@query("o159_canonical_delta", f"""WITH {RESP}, e AS ({EFFECT.format(r='', e='')}), z AS (SELECT jsd_cross - jsd_permutation AS d FROM e WHERE jsd_cross - jsd_permutation IS NOT NULL)
    SELECT count(*) AS n, round(avg(d), 6) AS delta, round(avg(d) - 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d) / sqrt(count(*)), 6) AS high, round(avg((d > 0)::INT), 6) AS share FROM z""")
def canonical_delta(spark, d):
    out = M.paired_delta(arms.order_effect(responses(spark, d)), "jsd_cross", "jsd_permutation")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("delta", "low", "high", "share")])


PAIRS = f"""{L}, o AS (SELECT label, token, count(*) AS c FROM t GROUP BY 1, 2), ab AS (SELECT u.label, u.token AS a, w.token AS b, count(*) AS k FROM t u JOIN t w ON u.row_id = w.row_id AND u.token < w.token GROUP BY ALL),
  gn AS (SELECT ab.label, a, b, ln(k::DOUBLE * n_d / (x.c * y.c)) AS g FROM ab JOIN nd ON nd.label = ab.label AND n_d >= 100 JOIN o x ON x.label = ab.label AND x.token = a JOIN o y ON y.label = ab.label AND y.token = b),
  s2 AS (SELECT u.row_id, gn.label, sum(g) AS s2 FROM t u JOIN t w ON u.row_id = w.row_id AND u.token < w.token JOIN gn ON gn.a = u.token AND gn.b = w.token GROUP BY 1, 2)"""


def correction(spark, d):
    rows, tokens = frames(spark, d)
    return M.pair_correction(rows, tokens, rows, 100)


@query("o086_pair_correction", f"WITH {PAIRS} SELECT row_id, label, round(s2, 5) AS s2 FROM s2")
def pair_correction(spark, d):
    return correction(spark, d).withColumn("s2", F.round("s2", 5))


@query("o087_corrected_fusion", f"WITH {PAIRS}, z AS (SELECT es.row_id, es.label, ln(greatest(p, 1e-9)) + s + coalesce(s2, 0) AS g FROM es JOIN pr USING (label) LEFT JOIN s2 ON s2.row_id = es.row_id AND s2.label = es.label) SELECT row_id, label, round(exp(g) / sum(exp(g)) OVER (PARTITION BY row_id), 5) AS p FROM z")
def corrected_fusion(spark, d):
    rows, tokens = frames(spark, d)
    sums = K.evidence_sums(tokens.select("row_id", "token"), K.count_ratio(tokens, rows)).join(correction(spark, d), ["row_id", "label"], "left")
    return K.fused(sums.select("row_id", "label", (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s")), K.prior(rows)).withColumn("p", F.round("p", 5))


POINTS = f"""{COND}, {L.removeprefix(L.split(', nd AS')[0] + ', ')}, lo AS (SELECT *, ln(least(greatest(p, 1e-4), 1 - 1e-4) / (1 - least(greatest(p, 1e-4), 1 - 1e-4))) AS lo FROM q),
  pt AS (SELECT b.item_id, b.label, b.lo - a.lo AS true_delta, cr.log_ratio AS stated_delta, sqrt(1 / greatest(a.support * a.p * (1 - a.p), 1e-12) + 1 / greatest(b.support * b.p * (1 - b.p), 1e-12)) AS se
    FROM lo b JOIN lo a ON a.label = b.label AND a.item_id = b.item_id + 100 JOIN cr ON cr.label = b.label AND cr.token = 'Brand#' || (b.item_id % 20 + 1)
    WHERE b.item_id <= 20 AND least(a.n, b.n) >= 3 AND abs(b.lo - a.lo) >= 0.05)"""


def sides(spark, d):
    """The posterior of each item before and after its second brand is known."""
    q = conditioned(spark, d)
    return q.filter("item_id between 101 and 120").withColumn("item_id", F.col("item_id") - 100), q.filter("item_id <= 20")


def points(spark, d):
    """The change of a label's odds by a second brand, in the rows and by the brand's log ratio."""
    rows, tokens = frames(spark, d)
    new = F.concat(F.lit("Brand#"), (F.col("item_id") % 20 + 1).cast("string"))
    before, after = sides(spark, d)
    stated = after.select("item_id", "label", new.alias("token")).join(K.count_ratio(tokens, rows), ["label", "token"]).select("item_id", "label", F.col("log_ratio").alias("stated_delta"))
    return M.change_points(before, after, stated, least_count=3)


LAST = """an AS (SELECT l_partkey % 20 + 1 AS item_id, l_linenumber % 2 AS odd, [l_quantity::DOUBLE, l_extendedprice / 1000, l_discount * 100, l_tax * 100, (l_suppkey % 50)::DOUBLE] AS w,
      row_number() OVER (PARTITION BY l_partkey % 20, l_linenumber % 2 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_discount DESC) AS k FROM lineitem WHERE l_tax <> 0.03),
  lv AS (SELECT item_id, odd, unnest(list_transform(w, lambda x: x / list_sum(w))) AS x, unnest(range(5)) AS i FROM an WHERE k = 1), lq AS (SELECT *, least(greatest(x, 1e-4), 1 - 1e-4) AS y FROM lv),
  ax AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i FROM pr),
  st AS (SELECT b.item_id, ax.label, ln(a.y / (1 - a.y)) - ln(b.y / (1 - b.y)) AS stated FROM lq b JOIN lq a ON a.item_id = b.item_id AND a.i = b.i AND a.odd = 0 AND b.odd = 1 JOIN ax ON ax.i = a.i)"""


@query("o099_last_valid", f"""WITH {POINTS}, {LAST} SELECT pt.item_id, pt.label, round(true_delta, 6) AS true_delta, round(stated, 6) AS stated_delta, round(se, 6) AS se FROM pt JOIN st ON st.item_id = pt.item_id AND st.label = pt.label""")
def last_valid_points(spark, d):
    """Lines answer for the item of their part, before or after by their number; a tax of 3 % makes an answer invalid, and
    of the many others of a phase the one shipped last counts."""
    rows, _ = frames(spark, d)
    w = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100, (F.col("l_suppkey") % 50).cast("double"))
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount"]
    phase = F.when(F.col("l_linenumber") % 2 == 0, "after").otherwise("before")
    answers = table(spark, d, "lineitem").select((F.col("l_partkey") % 20 + 1).cast("int").alias("item_id"), phase.alias("phase"), (F.col("l_tax") != 0.03).alias("valid"), V.normalised(w).alias("v"), *order)
    stated = M.stated_changes(answers, K.base_scores(K.prior(rows)).select("axis"), order)
    return rounded_points(M.change_points(*sides(spark, d), stated, least_count=3))


def rounded_points(points):
    return points.select("item_id", "label", *[r6(F.col(c)).alias(c) for c in ("true_delta", "stated_delta", "se")])


@query("o099_change_points", f"WITH {POINTS} SELECT item_id, label, round(true_delta, 6) AS true_delta, round(stated_delta, 6) AS stated_delta, round(se, 6) AS se FROM pt")
def change_points(spark, d):
    return points(spark, d).select("item_id", "label", *[r6(F.col(c)).alias(c) for c in ("true_delta", "stated_delta", "se")])


DECISIVE = f"""{L}, su AS (SELECT token, count(*) AS support FROM t GROUP BY 1), lo AS (SELECT label, token, least(greatest(n_de / support, 1e-4), 1 - 1e-4) AS a, least(greatest(pr.p, 1e-4), 1 - 1e-4) AS b FROM de JOIN su USING (token) JOIN pr USING (label) WHERE support >= 50),
  mo AS (SELECT label, token, round(abs(ln(a / (1 - a)) - ln(b / (1 - b))), 9) AS m FROM lo),
  de2 AS (SELECT row_id, min_by(token, struct_pack(a := -m, b := token)) FILTER (WHERE m IS NOT NULL) AS token, max(m) AS m, list(token ORDER BY token) AS ts FROM t LEFT JOIN mo USING (label, token) GROUP BY 1 HAVING count(*) >= 3 AND max(m) IS NOT NULL),
  re AS (SELECT row_id, token, m, list_filter(ts, lambda x: x <> token) AS r FROM de2)"""


@query("o149_decisive_items", f"""WITH {DECISIVE} SELECT row_id, token, round(m, 6) AS decisiveness, position, array_to_string(CASE position WHEN 'first' THEN [token] || r WHEN 'last' THEN r || [token]
    ELSE r[1:len(r) // 2] || [token] || r[len(r) // 2 + 1:] END, ' ') AS tokens FROM re, (VALUES ('first'), ('middle'), ('last')) z(position)""")
def decisive_items(spark, d):
    rows, tokens = frames(spark, d)
    best = rows.select("row_id", "tokens").join(M.decisive_token(tokens, rows, 3, 50), "row_id")
    z = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.array_join(M.placed(F.col("tokens"), F.col("token"), k), " ").alias("tokens")) for k in ("first", "middle", "last")]))
    return best.select("row_id", "token", r6(F.col("decisiveness")).alias("decisiveness"), z.alias("z")).select("row_id", "token", "decisiveness", "z.position", "z.tokens")


@query("o117_noise_ceiling", f"""WITH {P20}, s AS (SELECT label, i, avg(x) FILTER (WHERE rn <= 10) AS base, avg(x) FILTER (WHERE rn > 10 AND rn % 2 = 1) AS even, avg(x) FILTER (WHERE rn > 10 AND rn % 2 = 0) AS odd FROM l WHERE rn <= 16 GROUP BY 1, 2)
    SELECT label AS case_id, round(avg((sign(even - base) = sign(odd - base))::INT), 6) AS agreement, round(corr(even - base, odd - base) ** 2, 6) AS r_squared, round(regr_slope(odd - base, even - base), 6) AS slope
    FROM s WHERE base IS NOT NULL AND even IS NOT NULL AND odd IS NOT NULL GROUP BY 1""")
def noise_ceiling(spark, d):
    return M.split_half_shift(responses(spark, d)).select("case_id", *[r6(F.col(c)).alias(c) for c in ("agreement", "r_squared", "slope")])


#: Sizes of the subsets whose support is looked up.
SUBSETS = [1, 2, 3, 4, 5, 6, 8, 10]


@query("o142_feasibility", f"""WITH {C}, o AS (SELECT row_id, list(token ORDER BY md5(row_id || '|' || token), token) AS ts FROM t GROUP BY 1), e AS (SELECT row_id, k, list_sort(ts[1:k]) AS ev FROM o, (VALUES (1), (2), (3), (4), (5), (6), (8), (10)) z(k) WHERE len(ts) >= k),
    w AS (SELECT list(token ORDER BY token) AS ts FROM t GROUP BY row_id),
    b AS (SELECT list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS ev FROM (SELECT ts, unnest(range(1, 1 << len(ts))) AS m FROM w)), s AS (SELECT ev, count(*) AS support FROM b GROUP BY 1)
    SELECT k::INT AS k, count(*) AS n, median(support)::DOUBLE AS median_support, quantile_cont(support, 0.1)::DOUBLE AS p10_support, round(avg((support >= 500)::INT), 6) AS share FROM e JOIN s USING (ev) GROUP BY 1""")
def feasibility(spark, d):
    """Support of a drawn subset of each size of every row; rows with equal subsets share one look-up."""
    rows, tokens = frames(spark, d)
    drawn = M.drawn_subsets(tokens, SUBSETS)
    key = F.array_join("evidence", "|")
    items = kept(drawn.select(key.alias("item_id"), "evidence").distinct())
    support = K.supports(items, tokens, rows)
    s = F.col("support")
    return drawn.select("k", key.alias("item_id")).join(support, "item_id").groupBy("k").agg(F.count("*").alias("n"), F.median(s).alias("median_support"), F.percentile(s, 0.1).alias("p10_support"), r6(F.avg((s >= 500).cast("int"))).alias("share"))
