"""Vector algebra and arms over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import vectors as V
from tallyloom.operators import arms, sampling as S
from tallyloom.plans.bindings import ARM_SQL, JSD, P, P12, P20, RESP, posteriors, query, r6, responses, runs

PAIR = "FROM l a JOIN l b ON a.label = b.label AND a.i = b.i AND b.rn = a.rn + 1 GROUP BY a.vec_id"


def neighbours(spark, d):
    p = posteriors(spark, d)
    a = p.select(F.col("vec_id"), "label", "rn", F.col("v").alias("a"))
    b = p.select("label", (F.col("rn") - 1).alias("rn"), F.col("v").alias("b"))
    return a.join(b, ["label", "rn"])


def over_pairs(name, value, sql):
    query(name, f"WITH {P} SELECT a.vec_id, round({sql}, 6) AS value {PAIR}")(lambda s, d: neighbours(s, d).select("vec_id", r6(value(F.col("a"), F.col("b"))).alias("value")))


def over_rows(name, value, sql):
    query(name, f"WITH {P} SELECT vec_id, {sql} AS value FROM l GROUP BY vec_id")(lambda s, d: posteriors(s, d).select("vec_id", value(F.col("v")).alias("value")))


over_pairs("o049_kl", V.kl, "sum(CASE WHEN a.x > 1e-12 THEN a.x * log2(a.x / greatest(b.x, 1e-12)) ELSE 0 END)")
over_pairs("o050_jsd", V.jsd, JSD)
over_pairs("o052_total_variation", V.total_variation, "sum(abs(a.x - b.x)) / 2")
over_pairs("o063_l1", V.l1, "sum(abs(a.x - b.x))")
over_rows("o048_normalise", lambda v: r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), "round(sum(x * x), 6)")
over_rows("o055_entropy", lambda v: r6(V.entropy(v)), "round(sum(CASE WHEN x > 1e-12 THEN -x * log2(x) ELSE 0 END), 6)")
over_rows("o055_entropy_any", lambda v: r6(V.entropy(v, 0.0)), "round(sum(CASE WHEN x > 0 THEN -x * log2(x) ELSE 0 END), 6)")
over_rows("o056_informative", V.informative, "bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64)")
over_rows("o057_log_odds", lambda v: r6(F.aggregate(V.log_odds(v), F.lit(0.0), lambda s, x: s + x)), "round(sum(ln(least(greatest(x, 1e-4), 1 - 1e-4) / (1 - least(greatest(x, 1e-4), 1 - 1e-4)))), 6)")
over_rows("o058_top1", V.top1, "min_by(i, struct_pack(a := -x, b := i))")
over_rows("o059_softmax", lambda v: r6(F.array_max(V.softmax(v))), "round(exp(max(x) - max(x)) / sum(exp(x)) * exp(max(x)), 6)")
over_rows("o060_rank", lambda v: V.rank_of(v, F.lit(3)), "(1 + count(*) FILTER (WHERE x > (SELECT y.x FROM l y WHERE y.vec_id = l.vec_id AND y.i = 3)))::INT")
over_rows("o064_distinct_values", lambda v: V.distinct_values(v), "count(DISTINCT round(x, 5))::INT")


@query("o053_top_k_jaccard", f"""WITH {P}, k AS (SELECT vec_id, label, rn, i FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS z FROM l) WHERE z <= 5),
    c AS (SELECT a.vec_id, count(*) AS n FROM k a JOIN k b ON a.label = b.label AND b.rn = a.rn + 1 AND a.i = b.i GROUP BY 1)
    SELECT a.vec_id, round(coalesce(c.n, 0) / (10 - coalesce(c.n, 0)), 6) AS value FROM p a JOIN p b ON a.label = b.label AND b.rn = a.rn + 1 LEFT JOIN c ON c.vec_id = a.vec_id""")
def top_k_jaccard(spark, d):
    return neighbours(spark, d).select("vec_id", r6(V.jaccard(V.top_k(F.col("a"), 5), V.top_k(F.col("b"), 5))).alias("value"))


@query("o054_kendall", f"""WITH {P}, s AS (SELECT a.vec_id, a.i, a.x, b.x AS y FROM l a JOIN l b ON a.label = b.label AND a.i = b.i AND b.rn = a.rn + 1),
    q AS (SELECT u.vec_id, sum(sign(u.x - w.x) * sign(u.y - w.y)) AS c, count(*) FILTER (WHERE u.x <> w.x) AS nx, count(*) FILTER (WHERE u.y <> w.y) AS ny FROM s u JOIN s w ON u.vec_id = w.vec_id AND u.i < w.i GROUP BY 1)
    SELECT vec_id, round(CASE WHEN nx > 0 AND ny > 0 THEN c / sqrt(nx::DOUBLE * ny) ELSE 0 END, 6) AS value FROM q""")
def kendall(spark, d):
    """Tau-b; entries of a pair of vectors are joined with each other, a fixed number."""
    s = neighbours(spark, d).select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("i", "z")).select("vec_id", "i", "z.a", "z.b")
    t = s.select("vec_id", F.col("i").alias("j"), F.col("a").alias("c"), F.col("b").alias("e"))
    q = s.join(t, "vec_id").filter("i < j").groupBy("vec_id").agg(
        F.sum(F.signum(F.col("a") - F.col("c")) * F.signum(F.col("b") - F.col("e"))).alias("s"), F.count_if(F.col("a") != F.col("c")).alias("nx"), F.count_if(F.col("b") != F.col("e")).alias("ny")
    )
    return q.select("vec_id", r6(F.when((F.col("nx") > 0) & (F.col("ny") > 0), F.col("s") / F.sqrt(F.col("nx").cast("double") * F.col("ny"))).otherwise(0.0)).alias("value"))


@query("o051_mean_pairwise_jsd", f"WITH {RESP} SELECT case_id, round(avg(jsd), 6) AS mean_jsd, count(*) AS n_pairs FROM pr GROUP BY 1")
def mean_pairwise(spark, d):
    return arms.pairs(responses(spark, d)).groupBy("case_id").agg(r6(F.avg("jsd")).alias("mean_jsd"), F.count("*").alias("n_pairs"))


@query("o061_mean_vector", f"WITH {P} SELECT label, i, round(avg(x), 6) AS value FROM l GROUP BY 1, 2")
def mean_vector(spark, d):
    return posteriors(spark, d).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(r6(F.avg("x")).alias("value"))


@query("o062_scatter", """WITH n AS (SELECT DISTINCT o_orderpriority AS name FROM orders), q AS (SELECT o_custkey, o_orderpriority AS name, sum(o_totalprice) AS s FROM orders GROUP BY ALL)
    SELECT c.o_custkey, n.name, round(coalesce(q.s, 0), 2) AS value FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN n LEFT JOIN q USING (o_custkey, name)""")
def scatter(spark, d):
    from tallyloom.plans.bindings import table

    orders = table(spark, d, "orders")
    axis = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("axis"))  # the few labels
    rows = orders.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("s")).groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("names"), F.collect_list("s").alias("sums"))
    laid = rows.join(F.broadcast(axis)).select("o_custkey", F.explode(F.arrays_zip(F.col("axis").alias("n"), V.scattered(F.col("axis"), F.col("names"), F.col("sums")).alias("x"))).alias("z"))
    return laid.select("o_custkey", F.col("z.n").alias("name"), F.round("z.x", 2).alias("value"))


EFFECT = """SELECT case_id, {r}(avg(jsd) FILTER (WHERE a_arm = 'permutation' AND b_arm = 'permutation'){e}) AS jsd_permutation, {r}(avg(jsd) FILTER (WHERE a_arm = 'retest' AND b_arm = 'retest'){e}) AS jsd_retest,
  {r}(avg(jsd) FILTER (WHERE a_arm = 'shuffled' AND b_arm = 'shuffled'){e}) AS jsd_shuffled, {r}(avg(jsd) FILTER (WHERE a_arm = 'canonical' AND b_arm = 'canonical'){e}) AS jsd_canonical,
  {r}(avg(jsd) FILTER (WHERE (a_arm = 'permutation' AND b_arm = 'canonical') OR (b_arm = 'permutation' AND a_arm = 'canonical')){e}) AS jsd_cross,
  {r}(avg(jsd) FILTER (WHERE a_arm = 'permutation' AND b_arm = 'permutation') - avg(jsd) FILTER (WHERE a_arm = 'retest' AND b_arm = 'retest'){e}) AS order_effect FROM pa GROUP BY case_id"""
COLUMNS = ["jsd_permutation", "jsd_retest", "jsd_shuffled", "jsd_canonical", "jsd_cross", "order_effect"]


@query("o091_order_effect", f"WITH {RESP} " + EFFECT.format(r="round", e=", 6"))
def order_effect(spark, d):
    return arms.order_effect(responses(spark, d)).select("case_id", *[r6(c).alias(c) for c in COLUMNS])


@query("o091_case_shape", f"""WITH {P20}, t AS (SELECT vec_id, label, min_by(i, struct_pack(a := -x, b := i)) AS top, sum(CASE WHEN x > 1e-12 THEN -x * log2(x) ELSE 0 END) AS h, bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64) AS told FROM l WHERE rn <= 10 GROUP BY 1, 2),
    m AS (SELECT label, top, count(*) AS n FROM t GROUP BY 1, 2)
    SELECT label AS case_id, count(DISTINCT top) > 1 AS flips, round((SELECT max(n) FROM m WHERE m.label = t.label) / count(*), 6) AS modal_share, round(avg(h), 6) AS mean_entropy, round(avg(told::INT), 6) AS informative_share FROM t GROUP BY label""")
def case_shape(spark, d):
    return arms.case_shape(responses(spark, d)).select("case_id", "flips", *[r6(c).alias(c) for c in ("modal_share", "mean_entropy", "informative_share")])


CEILING = "q AS (SELECT a.label AS u, b.label AS w, " + JSD + " AS jsd FROM l a JOIN l b ON a.i = b.i AND a.label < b.label AND a.rn = 1 AND b.rn = 1 GROUP BY 1, 2)"


@query("o092_summary", f"WITH {RESP}, e AS ({EFFECT.format(r='', e='')}), {CEILING} SELECT round(avg(order_effect), 6) AS order_effect, round(CASE WHEN (SELECT avg(jsd) FROM q) - avg(jsd_retest) > 1e-9 THEN avg(order_effect) / ((SELECT avg(jsd) FROM q) - avg(jsd_retest)) END, 6) AS normalised FROM e")
def summary(spark, d):
    rows = responses(spark, d)
    effect = arms.order_effect(rows).agg(F.avg("order_effect").alias("e"), F.avg("jsd_retest").alias("floor"))
    both = effect.join(F.broadcast(arms.ceiling(rows)))  # a row each
    room = F.col("ceiling") - F.col("floor")
    return both.select(r6(F.col("e")).alias("order_effect"), r6(F.when(room > 1e-9, F.col("e") / room)).alias("normalised"))


@query("o093_ceiling", f"WITH {P20}, {CEILING} SELECT round(avg(jsd), 6) AS ceiling, count(*) AS n_pairs FROM q")
def ceiling(spark, d):
    return arms.ceiling(responses(spark, d)).select(r6(F.col("ceiling")).alias("ceiling"), "n_pairs")


@query("o093_drawn_ceiling", f"""WITH {P20}, an AS (SELECT label, row_number() OVER (ORDER BY substr(sha1(label), 1, 3), label) - 1 AS place FROM (SELECT label FROM l WHERE rn = 1 GROUP BY 1 HAVING bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64))),
    d AS (SELECT d, ('0x' || substr(sha1('za|' || d), 1, 13))::BIGINT % (SELECT count(*) FROM an) AS a, ('0x' || substr(sha1('zb|' || d), 1, 13))::BIGINT % (SELECT count(*) FROM an) AS b FROM range(20000) r(d)),
    q AS (SELECT d, {JSD} AS jsd FROM d JOIN an x ON x.place = d.a JOIN an y ON y.place = d.b JOIN l a ON a.label = x.label AND a.rn = 1 JOIN l b ON b.label = y.label AND b.rn = 1 AND b.i = a.i WHERE d.a <> d.b GROUP BY 1)
    SELECT round(avg(jsd), 6) AS ceiling, count(*) AS n_pairs FROM q""")
def drawn_ceiling(spark, d):
    return arms.drawn_ceiling(responses(spark, d)).select(r6(F.col("ceiling")).alias("ceiling"), "n_pairs")


@query("o095_informative_by_arm", f"WITH {P20}, t AS (SELECT vec_id, rn, bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64) AS told FROM l WHERE rn <= 20 GROUP BY 1, 2) SELECT {ARM_SQL} AS arm, round(avg(told::INT), 6) AS informative_rate FROM t GROUP BY 1")
def by_arm(spark, d):
    return responses(spark, d).groupBy("arm").agg(r6(F.avg(V.informative(F.col("v")).cast("int"))).alias("informative_rate"))


@query("o096_k_sweep", f"WITH {RESP} SELECT k::INT AS k, case_id, round(avg(jsd) FILTER (WHERE b_arm = 'permutation') , 6) AS jsd_permutation FROM pa, (VALUES (2), (3), (5), (10)) z(k) WHERE a_arm = 'permutation' AND b_rn <= k GROUP BY 1, 2")
def k_sweep(spark, d):
    p = arms.pairs(responses(spark, d).filter("arm = 'permutation'"))
    sweep = p.select("case_id", "jsd", F.explode(F.filter(F.array(*[F.lit(k) for k in (2, 3, 5, 10)]), lambda k: F.greatest("a_idx", "b_idx") < k)).alias("k"))
    return sweep.groupBy("k", "case_id").agg(r6(F.avg("jsd")).alias("jsd_permutation"))


@query("o097_instability", f"""WITH {P20}, k AS (SELECT label, i FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS z FROM l WHERE rn <= 10) WHERE z <= 5),
    c AS (SELECT label, i, count(*) AS n FROM k GROUP BY 1, 2) SELECT label AS case_id, bool_or(n < 10 AND coalesce(p_size % 5, 5) <= 2) AS unstable FROM c LEFT JOIN part ON p_partkey = i GROUP BY 1""")
def instability(spark, d):
    from tallyloom.plans.bindings import table

    severity = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("entry"), (F.col("p_size") % 5).alias("severity"))
    return arms.instability(responses(spark, d), severity)


@query("o102_redundancy", f"""WITH {P20}, t AS (SELECT a.label || '|' || a.rn AS item_id, {JSD} AS jsd, sum(CASE WHEN b.x > 1e-12 THEN -b.x * log2(b.x) ELSE 0 END) - sum(CASE WHEN a.x > 1e-12 THEN -a.x * log2(a.x) ELSE 0 END) AS entropy_change,
      min_by(a.i, struct_pack(p := -a.x, q := a.i)) <> min_by(b.i, struct_pack(p := -b.x, q := b.i)) AS flip, max(b.x) - max(a.x) AS max_change
    FROM l a JOIN l b ON a.label = b.label AND a.i = b.i AND b.rn = a.rn + 10 WHERE a.rn <= 10 GROUP BY 1)
    SELECT item_id, round(jsd, 6) AS jsd, round(entropy_change, 6) AS entropy_change, flip, round(max_change, 6) AS max_change FROM t""")
def redundancy(spark, d):
    """Items are the places 1 to 10 of each run of 20, with the place ten further as the other phase."""
    p = runs(posteriors(spark, d), 20)
    rows = p.select(F.concat_ws("|", "case_id", (F.col("rn") - 1) % 10 + 1).alias("item_id"), F.when(F.col("rn") <= 10, "without").otherwise("with").alias("phase"), "v")
    out = arms.phase_change(rows)
    return out.select("item_id", r6(F.col("jsd")).alias("jsd"), r6(F.col("entropy_change")).alias("entropy_change"), "flip", r6(F.col("max_change")).alias("max_change"))


POSITION = "CASE WHEN {rn} <= 4 THEN 'first' WHEN {rn} <= 8 THEN 'middle' ELSE 'last' END"
LO = "ln(least(greatest(x, 1e-4), 1 - 1e-4) / (1 - least(greatest(x, 1e-4), 1 - 1e-4)))"
#: o: the target's log-odds of every response of the cases with six or more.
PLACED = f"""{P12}, big AS (SELECT label FROM p GROUP BY 1 HAVING count(*) >= 6),
    o AS (SELECT label AS case_id, {POSITION.format(rn="rn")} AS position, CASE WHEN rn <= 4 THEN -1 WHEN rn <= 8 THEN 0 ELSE 1 END AS code, {LO} AS lo FROM l WHERE i = target AND label IN (SELECT label FROM big))"""


def positioned(spark, d):
    """Runs of 12 places as cases, four at each position; the label is the target's entry."""
    return runs(posteriors(spark, d), 12).select("case_id", "vec_id", F.expr(POSITION.format(rn="rn")).alias("position"), F.col("label").alias("target"), "v")


@query("o103_position_effect", f"""WITH {PLACED},
    j AS (SELECT a.label AS case_id, a.rn AS ra, b.rn AS rb, {JSD} AS jsd FROM l a JOIN l b ON a.label = b.label AND a.i = b.i AND a.rn < b.rn WHERE a.label IN (SELECT label FROM big) GROUP BY ALL),
    k AS (SELECT *, {POSITION.format(rn="ra")} AS pa, {POSITION.format(rn="rb")} AS pb FROM j),
    w AS (SELECT case_id, avg(jsd) AS within FROM k WHERE pa = pb GROUP BY 1),
    b AS (SELECT case_id, avg(m) AS between_ FROM (SELECT case_id, pa, pb, avg(jsd) AS m FROM k WHERE pa <> pb GROUP BY ALL) GROUP BY 1),
    e AS (SELECT *, avg(lo) OVER (PARTITION BY case_id) AS g, avg(lo) OVER (PARTITION BY case_id, position) AS m FROM o),
    h AS (SELECT case_id, count(*) AS n, sum((m - g) ** 2) AS sb, sum((lo - g) ** 2) AS st, avg(lo) FILTER (WHERE code = -1) AS f, avg(lo) FILTER (WHERE code = 0) AS md, avg(lo) FILTER (WHERE code = 1) AS la FROM e GROUP BY 1),
    t AS (SELECT label AS case_id, {POSITION.format(rn="rn")} AS position, min_by(i, struct_pack(a := -x, b := i)) AS top FROM l WHERE label IN (SELECT label FROM big) GROUP BY label, vec_id, rn),
    m AS (SELECT case_id, position, min_by(top, struct_pack(a := -n, b := top)) AS modal FROM (SELECT case_id, position, top, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1, 2),
    z AS (SELECT case_id, count(DISTINCT modal) > 1 AS flip FROM m GROUP BY 1)
    SELECT case_id, n, round(within, 6) AS within, round(between_, 6) AS between, round(f, 6) AS logodds_first, round(md, 6) AS logodds_middle, round(la, 6) AS logodds_last,
      round(CASE WHEN st > 1e-12 THEN sb / st END, 6) AS eta_squared, flip FROM h JOIN z USING (case_id) LEFT JOIN w USING (case_id) LEFT JOIN b USING (case_id)""")
def position_effect(spark, d):
    out = arms.position_effect(positioned(spark, d))
    return out.select("case_id", "n", "flip", *[r6(F.col(c)).alias(c) for c in ("within", "between", "logodds_first", "logodds_middle", "logodds_last", "eta_squared")])


@query("o104_position_slope", f"""WITH {PLACED}, c AS (SELECT case_id, code, lo - avg(lo) OVER (PARTITION BY case_id) AS y FROM o), {S.weights_sql("c", "case_id", "a4", 50)},
    b AS (SELECT r, (sum(w * code * y) / sum(w) - sum(w * code) / sum(w) * sum(w * y) / sum(w)) / (sum(w * code * code) / sum(w) - (sum(w * code) / sum(w)) ** 2) AS slope FROM c JOIN weights USING (case_id) GROUP BY 1)
    SELECT round((SELECT regr_slope(y, code) FROM c), 6) AS slope, round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high, (SELECT count(DISTINCT case_id) FROM c) AS n_cases FROM b""")
def position_slope(spark, d):
    out = arms.position_slope(positioned(spark, d), 50)
    return out.select(*[r6(F.col(c)).alias(c) for c in ("slope", "low", "high")], "n_cases")


@query("o124_uniform_collapse", f"""WITH {P}, t AS (SELECT label, vec_id, count(DISTINCT round(x, 5)) AS n, max(x) AS m, bool_or(abs(x - 1.0 / 64) > 1e-6 + 1e-5 / 64) AS told FROM l GROUP BY 1, 2)
    SELECT label, count(*) AS n, round(avg(n), 6) AS mean_distinct, round(avg(m), 6) AS mean_max, round(avg((NOT told)::INT), 6) AS uniform_share FROM t GROUP BY 1""")
def uniform_collapse(spark, d):
    v = F.col("v")
    return posteriors(spark, d).groupBy("label").agg(F.count("*").alias("n"), r6(F.avg(V.distinct_values(v))).alias("mean_distinct"), r6(F.avg(F.array_max(v))).alias("mean_max"), r6(F.avg((~V.informative(v)).cast("int"))).alias("uniform_share"))


@query("o123_displacement", f"WITH {RESP} SELECT round(avg(jsd), 6) AS mean, round(median(jsd), 6) AS median, round(quantile_cont(jsd, 0.95), 6) AS p95, count(*) AS n FROM pa WHERE a_rn + 10 = b_rn")
def displacement(spark, d):
    from tallyloom.operators import quality as Q

    p = arms.pairs(runs(posteriors(spark, d), 20), keep=("rn",)).filter("a_rn + 10 = b_rn")
    places = Q.quantiles(p, [], "jsd", {"median": 0.5, "p95": 0.95})
    return p.agg(r6(F.avg("jsd")).alias("mean"), F.count("*").alias("n")).crossJoin(F.broadcast(places.select(r6(F.col("median")).alias("median"), r6(F.col("p95")).alias("p95"))))  # a row each


@query("o116_above_null", f"""WITH {RESP}, n AS (SELECT case_id, quantile_cont(jsd, 0.95) AS q FROM pa WHERE a_arm = 'retest' AND b_arm = 'retest' GROUP BY 1)
    SELECT case_id, round(q, 6) AS p95, round(avg((jsd > q)::INT), 6) AS share_above FROM pa JOIN n USING (case_id) WHERE a_arm = 'permutation' AND b_arm = 'permutation' GROUP BY 1, q""")
def above_null(spark, d):
    p = arms.pairs(responses(spark, d))
    null = p.filter("a_arm = 'retest' and b_arm = 'retest'").groupBy("case_id").agg(F.percentile("jsd", 0.95).alias("q"))
    return p.filter("a_arm = 'permutation' and b_arm = 'permutation'").join(null, "case_id").groupBy("case_id").agg(r6(F.max("q")).alias("p95"), r6(F.avg((F.col("jsd") > F.col("q")).cast("int"))).alias("share_above"))
