"""Audit checks, comparisons, parsing and sampling over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import arms, figures, jobs, quality as Q, sampling as S
from tallyloom.plans.bindings import C, corpus, query, r6, table


@query("o127_nulls", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, {e} AS empty FROM documents" for c, e in (("doc_id", "0::BIGINT"), ("text", "count(*) FILTER (WHERE text = '')"), ("lang", "count(*) FILTER (WHERE lang = '')"), ("words", "count(*) FILTER (WHERE text = '')"))).replace("words IS NULL", "text IS NULL"))
def nulls(spark, d):
    return Q.null_counts(table(spark, d, "documents").select("doc_id", "text", "lang", F.when(F.length("text") == 0, F.array().cast("array<string>")).otherwise(F.split("text", " ")).alias("words")))


@query("o128_duplicates", "WITH k AS (SELECT text, count(*) AS n, count(DISTINCT source) AS s FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n - 1)::BIGINT AS n_beyond, count(*) FILTER (WHERE s > 1) AS keys_across, coalesce(sum(n) FILTER (WHERE s > 1), 0)::BIGINT AS rows_across FROM k")
def duplicates(spark, d):
    docs = table(spark, d, "documents")
    return Q.duplicates(docs, F.sha2("text", 256), F.col("source"))


@query("o128_multiset_duplicates", """WITH k AS (SELECT l_orderkey, l_returnflag AS first, string_agg(l_quantity::INT::VARCHAR, ',' ORDER BY l_quantity::INT::VARCHAR) AS m, min(year(l_shipdate)) AS split FROM lineitem GROUP BY 1, 2),
    g AS (SELECT first, m, count(*) AS n, count(DISTINCT split) AS s FROM k GROUP BY ALL)
    SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n - 1)::BIGINT AS n_beyond, count(*) FILTER (WHERE s > 1) AS keys_across, coalesce(sum(n) FILTER (WHERE s > 1), 0)::BIGINT AS rows_across FROM g""")
def multiset_duplicates(spark, d):
    """Quantities of an order's lines of one flag as a multiset: equal ones may stand several times."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(F.col("l_quantity").cast("int").cast("string")).alias("m"), F.min(F.year("l_shipdate")).alias("split"))
    key = F.sha2(F.concat_ws("|", "l_returnflag", F.array_join(F.array_sort("m"), ",")), 256)
    return Q.duplicates(rows, key, F.col("split"))


@query("o129_quantiles", "WITH q AS (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])::DOUBLE AS q, unnest(quantile_cont(c_acctbal, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])) AS v FROM customer) SELECT q, round(v, 4) AS value FROM q")
def quantiles(spark, d):
    at = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    row = Q.quantiles(table(spark, d, "customer"), [], "c_acctbal", {f"q{i}": q for i, q in enumerate(at)})
    return row.select(F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.round(f"q{i}", 4).alias("value")) for i, q in enumerate(at)])).alias("z")).select("z.*")


@query("o129_ranges", "SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal NOT BETWEEN 0 AND 9000) AS outside, count(DISTINCT c_mktsegment) AS n_segments, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer")
def ranges(spark, d):
    return table(spark, d, "customer").agg(F.count("*").alias("n"), F.count_if(~F.col("c_acctbal").between(0, 9000)).alias("outside"), F.count_distinct("c_mktsegment").alias("n_segments"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))  # the few segments


@query("o130_token_validity", "SELECT p_brand AS token, count(*) AS n, CASE WHEN regexp_matches(p_brand, '^Brand#[0-9]+$') THEN CASE WHEN substr(p_brand, 7)::INT <= 20 THEN 'known' ELSE 'unknown' END ELSE 'malformed' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, token LIMIT 30")
def token_validity(spark, d):
    n = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("token")).agg(F.count("*").alias("n"))
    kind = F.when(~F.col("token").rlike("^Brand#[0-9]+$"), "malformed").when(F.substring("token", 7, 9).cast("int") <= 20, "known").otherwise("unknown")
    return n.withColumn("kind", kind).orderBy(F.desc("n"), "token").limit(30)


SHARES = "WITH s AS (SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS v, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1)"


def order_shares(spark, d):
    z = F.struct((-F.col("l_extendedprice")).alias("x"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(z)).alias("z"), F.sum("l_extendedprice").alias("t"))
    return s.select("l_orderkey", F.transform("z", lambda q: -q["x"]).alias("v"), F.col("z.l_partkey").alias("parts"), "t")


@query("o131_wellformed", """WITH e AS (SELECT l_orderkey, l_extendedprice - 3000 AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
    f AS (SELECT *, lag(x) OVER (PARTITION BY l_orderkey ORDER BY k) AS before FROM e),
    s AS (SELECT l_orderkey, count(*) AS n, sum(x) AS t, max(o_totalprice) AS total, bool_or(x > before + 1e-12) AS rising, bool_or(x < 0) AS negative FROM f JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT count(*) AS n, count(*) FILTER (WHERE abs(t / total - 1) > 1e-6) AS off_sum, count(*) FILTER (WHERE coalesce(rising, false)) AS rising, count(*) FILTER (WHERE negative) AS negative, max(n)::INT AS most FROM s""")
def wellformed(spark, d):
    """Lines in the order of their numbers, less 3000: lists that rise, fall below 0 and miss their total."""
    from tallyloom.functions.vectors import falling, total

    z = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(z)).alias("z")).join(table(spark, d, "orders"), "o_orderkey")
    s = s.select(F.transform("z", lambda q: q["l_extendedprice"] - 3000).alias("v"), "o_totalprice")
    v = F.col("v")
    return s.agg(F.count("*").alias("n"), F.count_if(F.abs(total(v) / F.col("o_totalprice") - 1) > 1e-6).alias("off_sum"), F.count_if(~falling(v)).alias("rising"), F.count_if(F.array_min(v) < 0).alias("negative"), F.max(F.size(v)).alias("most"))


@query("o132_truth_rank", "WITH r AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem), f AS (SELECT l_orderkey, min(k) AS k FROM r WHERE l_partkey % 3 = 0 GROUP BY 1), o AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT count(*) AS n, count(k) AS contained, round(avg((k = 1)::INT), 6) AS top1, round(avg((k <= 5)::INT), 6) AS top5, round(avg(k), 6) AS mean_rank, round(median(k), 6) AS median_rank FROM o LEFT JOIN f USING (l_orderkey)")
def truth_rank(spark, d):
    k = F.array_position(F.transform("parts", lambda p: p % 3), 0)
    s = order_shares(spark, d).select(F.nullif(k, F.lit(0).cast("long")).alias("k"))
    return s.agg(F.count("*").alias("n"), F.count("k").alias("contained"), r6(F.avg((F.col("k") == 1).cast("int"))).alias("top1"), r6(F.avg((F.col("k") <= 5).cast("int"))).alias("top5"), r6(F.avg("k")).alias("mean_rank"), r6(F.median("k")).alias("median_rank"))


@query("o133_coverage", "WITH s AS (SELECT DISTINCT o_orderpriority AS label, p_brand AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey), a AS (SELECT DISTINCT o_orderpriority AS label, p.p_brand AS code FROM orders CROSS JOIN (SELECT DISTINCT p_brand FROM part WHERE p_size < 25) p) SELECT 'undeclared' AS kind, count(*) AS n FROM (SELECT * FROM s EXCEPT SELECT * FROM a) UNION ALL SELECT 'never seen', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM s)")
def kb_coverage(spark, d):
    from tallyloom.plans.bindings import exploded

    seen = exploded(corpus(spark, d)).select("label", F.col("token").alias("code")).distinct()
    allowed = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")).distinct().crossJoin(table(spark, d, "part").filter("p_size < 25").select(F.col("p_brand").alias("code")).distinct())
    one = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("undeclared", seen.join(allowed, ["label", "code"], "left_anti")).unionByName(one("never seen", allowed.join(seen, ["label", "code"], "left_anti")))


@query("o120_replicate_differences", "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), v AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), s AS (SELECT sum(n * (n - 1) // 2) AS same FROM v), p AS (SELECT sum(n * (n - 1) // 2) AS pairs FROM g) SELECT pairs::BIGINT AS n_pairs, (pairs - same)::BIGINT AS n_differ FROM s, p")
def replicate_differences(spark, d):
    return Q.replicate_pairs(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


REPL = """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100] AS w FROM lineitem), n AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS v, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, w) AS k FROM b),
  e AS (SELECT l_orderkey, l_linenumber, k, unnest(v) AS x, unnest(range(4)) AS i FROM n),
  j AS (SELECT a.l_orderkey, a.l_linenumber, a.k, b.k AS kk, least(1, greatest(0, sum(CASE WHEN a.x > 1e-12 THEN a.x * log2(a.x / ((a.x + b.x) / 2)) / 2 ELSE 0 END + CASE WHEN b.x > 1e-12 THEN b.x * log2(b.x / ((a.x + b.x) / 2)) / 2 ELSE 0 END))) AS jsd, sum(abs(a.x - b.x)) AS l1, (min_by(i, struct_pack(p := -a.x, q := i)) <> min_by(i, struct_pack(p := -b.x, q := i)))::INT AS flip FROM e a JOIN e b USING (l_orderkey, l_linenumber, i) WHERE a.k < b.k GROUP BY ALL)"""


@query("o134_replicates", REPL + " SELECT count(*) AS n_pairs, count(*) FILTER (WHERE jsd > 1e-9) AS n_differ, round(avg(jsd), 6) AS mean_jsd, round(median(jsd), 6) AS median_jsd, round(quantile_cont(jsd, 0.9), 6) AS p90, round(quantile_cont(jsd, 0.99), 6) AS p99, round(max(jsd), 6) AS max_jsd, round(avg(l1), 6) AS mean_l1, round(avg(flip), 6) AS flip_rate FROM j")
def replicates(spark, d):
    from tallyloom.functions.vectors import jsd, l1, normalised, top1

    w = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    key = ["l_orderkey", "l_linenumber"]
    rows = table(spark, d, "lineitem").select(*key, "l_partkey", "l_suppkey", w.alias("w"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("l_partkey", "l_suppkey", "w"))).select(*key, "k", normalised(F.col("w")).alias("v"))
    p = rows.join(rows.select(*key, F.col("k").alias("kk"), F.col("v").alias("u")), key).filter("k < kk").select(jsd(F.col("v"), F.col("u")).alias("jsd"), l1(F.col("v"), F.col("u")).alias("l1"), (top1(F.col("v")) != top1(F.col("u"))).cast("int").alias("flip"))
    j = F.col("jsd")
    means = p.agg(F.count("*").alias("n_pairs"), F.count_if(j > 1e-9).alias("n_differ"), r6(F.avg(j)).alias("mean_jsd"), r6(F.max(j)).alias("max_jsd"), r6(F.avg("l1")).alias("mean_l1"), r6(F.avg("flip")).alias("flip_rate"))
    places = Q.quantiles(p, [], "jsd", {"median_jsd": 0.5, "p90": 0.9, "p99": 0.99})
    return means.crossJoin(F.broadcast(places.select(*[r6(F.col(c)).alias(c) for c in places.columns])))  # a row each


@query("o135_class_balance", "WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / min(n) OVER (), 6) AS imbalance, round((SELECT sum(-(n / s) * log2(n / s)) FROM n, (SELECT sum(n) AS s FROM n)), 6) AS entropy FROM n")
def class_balance(spark, d):
    rows = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "label")
    return Q.balance(rows, "label").select("label", "n", *[r6(F.col(c)).alias(c) for c in ("share", "imbalance", "entropy")])


@query("o135_severity_mass", "SELECT round(sum(n) FILTER (WHERE severity <= 2) / sum(n), 6) AS severe_share, round(sum(n * severity) / sum(n), 6) AS mean_severity FROM (SELECT left(o_orderpriority, 1)::INT AS severity, count(*) AS n FROM orders GROUP BY 1)")
def severity_mass(spark, d):
    n = table(spark, d, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("severity")).agg(F.count("*").alias("n"))
    return n.agg(r6(F.sum(F.when(F.col("severity") <= 2, F.col("n"))) / F.sum("n")).alias("severe_share"), r6(F.sum(F.col("n") * F.col("severity")) / F.sum("n")).alias("mean_severity"))


@query("o136_evidence_load", f"WITH {C}, n AS (SELECT row_id, count(*) AS n FROM t GROUP BY 1), q AS (SELECT quantile_cont(n, 0.25) AS q1, median(n) AS median, quantile_cont(n, 0.75) AS q3 FROM n) SELECT q1, median::DOUBLE AS median, q3, q3 + 1.5 * (q3 - q1) AS fence, (SELECT count(*) FROM n WHERE n > q3 + 1.5 * (q3 - q1)) AS n_above FROM q")
def evidence_load(spark, d):
    return Q.outliers(corpus(spark, d).select(F.size("tokens").alias("n")), "n")


@query("o137_split_shift", "WITH n AS (SELECT year(l_shipdate)::VARCHAR AS split, l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT s.split, c.category, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT split FROM n) s CROSS JOIN (SELECT DISTINCT category FROM n) c LEFT JOIN n ON n.split = s.split AND n.category = c.category), p AS (SELECT *, n / sum(n) OVER (PARTITION BY split) + 1e-9 AS p FROM g) SELECT b.split, round(sum((b.p - a.p) * ln(b.p / a.p)), 8) AS psi FROM p b JOIN p a ON a.category = b.category AND a.split = '1996' WHERE b.split <> '1996' GROUP BY 1")
def split_shift(spark, d):
    return Q.stability_index(table(spark, d, "lineitem"), F.year("l_shipdate"), F.col("l_returnflag"), "1996").withColumn("psi", F.round("psi", 8))


@query("o138_plausibility", "SELECT 'a' AS rule, p_type AS code, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) LIKE '%widget%' AND l_returnflag = 'R' GROUP BY 2 UNION ALL SELECT 'b', p_type, count(*) FROM lineitem JOIN part ON p_partkey = l_partkey WHERE lower(p_name) LIKE '%bolt%' AND l_returnflag = 'N' GROUP BY 2")
def plausibility(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rule = F.when(F.lower("p_name").like("%widget%") & (F.col("l_returnflag") == "R"), "a").when(F.lower("p_name").like("%bolt%") & (F.col("l_returnflag") == "N"), "b")
    return rows.withColumn("rule", rule).filter("rule is not null").groupBy("rule", F.col("p_type").alias("code")).agg(F.count("*").alias("n"))


@query("o139_low_quantile", "WITH k AS (SELECT p_brand, l_quantity AS v, row_number() OVER (PARTITION BY p_brand ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT p_brand, v AS value, n FROM k WHERE k = round(0.01 * (n - 1))")
def low_quantile(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return Q.nearest_rank(rows.select("p_brand", "l_quantity"), ["p_brand"], "l_quantity", 0.01)


@query("o140_severity", "SELECT left(o_orderpriority, 1)::INT AS severity, count(*) AS n, (left(o_orderpriority, 1)::INT <= 2) AS severe FROM orders GROUP BY 1")
def severity(spark, d):
    s = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, d, "orders").groupBy(s.alias("severity")).agg(F.count("*").alias("n")).withColumn("severe", F.col("severity") <= 2)


PRED = "CASE WHEN regexp_matches(text, '[#*%|]') THEN 0 WHEN n_chars < 60 THEN NULL ELSE 1 END"
ACC = "WITH r AS (SELECT lang, quality, " + PRED + " AS p FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, count(*) AS n, avg((p = quality)::INT) AS a, count(DISTINCT quality) AS c FROM r WHERE p IS NOT NULL GROUP BY 1), s AS (SELECT lang, p, count(*) AS k FROM r WHERE p IS NOT NULL GROUP BY 1, 2), h AS (SELECT lang, max(k / t) AS m, sum(-(k / t) * log2(k / t)) AS e FROM (SELECT *, sum(k) OVER (PARTITION BY lang) AS t FROM s) GROUP BY 1)"


def predictions(spark, d):
    p = F.when(F.col("text").rlike("[#*%|]"), 0).when(F.col("n_chars") < 60, F.lit(None).cast("int")).otherwise(1)
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "source", "quality", "toxic", p.alias("predicted"), "n_chars")


@query("o110_competence", ACC + " SELECT lang, n, round(a, 6) AS accuracy, round(greatest(0, (a + 1.96*1.96/(2*n))/(1+1.96*1.96/n) - 1.96/(1+1.96*1.96/n)*sqrt(a*(1-a)/n + 1.96*1.96/(4.0*n*n))), 6) AS low, round(least(1, (a + 1.96*1.96/(2*n))/(1+1.96*1.96/n) + 1.96/(1+1.96*1.96/n)*sqrt(a*(1-a)/n + 1.96*1.96/(4.0*n*n))), 6) AS high, round(a * c, 6) AS to_chance, round(m, 6) AS top_share, round(e, 6) AS answer_entropy FROM g JOIN h USING (lang)")
def competence(spark, d):
    out = Q.accuracy(predictions(spark, d), ["lang"], "quality", "predicted")
    return out.select("lang", "n", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query("o111_gate", ACC + " SELECT lang, round(a, 6) AS accuracy, a > 0.5 AS beats_chance, a > 0.9 AS strong FROM g")
def gate(spark, d):
    out = Q.accuracy(predictions(spark, d), ["lang"], "quality", "predicted")
    return out.select("lang", r6(F.col("accuracy")).alias("accuracy"), (F.col("accuracy") > 0.5).alias("beats_chance"), (F.col("accuracy") > 0.9).alias("strong")).orderBy(F.desc("accuracy"))


@query("o122_validity", "SELECT lang, round(avg((p IS NOT NULL)::INT) FILTER (WHERE toxic = 0), 6) AS plain, round(avg((p IS NOT NULL)::INT) FILTER (WHERE toxic = 1), 6) AS toxic FROM (SELECT lang, toxic, " + PRED + " AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1")
def validity(spark, d):
    wide = predictions(spark, d).groupBy("lang").pivot("toxic", [0, 1]).agg(r6(F.avg(F.col("predicted").isNotNull().cast("int"))))
    return wide.withColumnsRenamed({"0": "plain", "1": "toxic"})


@query("o160_mcnemar", "WITH r AS (SELECT (" + PRED + " = quality) AS a, ((n_chars > 400)::INT = quality) AS b FROM documents JOIN labels USING (doc_id)), n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS x, count(*) FILTER (WHERE NOT a AND b) AS y FROM r) SELECT x AS only_first, y AS only_second, round((abs(x - y) - 1) ** 2 / (x + y), 6) AS chi_squared FROM n")
def mcnemar(spark, d):
    rows = predictions(spark, d).select((F.col("predicted") == F.col("quality")).alias("a"), ((F.col("n_chars") > 400).cast("int") == F.col("quality")).alias("b"))
    return Q.mcnemar(rows, "a", "b").withColumn("chi_squared", r6(F.col("chi_squared")))


@query("o098_weighted_line", "WITH s AS (SELECT l_returnflag, sum(l_quantity) AS w, sum(l_quantity * l_discount) AS x, sum(l_quantity * l_extendedprice) AS y, sum(l_quantity * l_discount ** 2) AS xx, sum(l_quantity * l_discount * l_extendedprice) AS xy, sum(l_quantity * l_extendedprice ** 2) AS yy FROM lineitem GROUP BY 1), m AS (SELECT l_returnflag, x / w AS x, y / w AS y, xx / w - (x / w) ** 2 AS vx, yy / w - (y / w) ** 2 AS vy, xy / w - (x / w) * (y / w) AS c FROM s) SELECT l_returnflag, round(c / vx, 2) AS slope, round(y - c / vx * x, 2) AS intercept, round(c * c / (vx * vy), 8) AS r_squared FROM m")
def weighted_line(spark, d):
    out = arms.weighted_line(table(spark, d, "lineitem"), "l_discount", "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 2).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r_squared", 8).alias("r_squared"))


@query("o100_spearman", "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman(spark, d):
    return Q.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").withColumn("spearman", r6(F.col("spearman")))


@query("o119_ladders", "WITH s AS (SELECT c_mktsegment, year(o_orderdate)::INT AS y, avg(o_totalprice) AS m FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), g AS (SELECT *, lag(m) OVER (PARTITION BY c_mktsegment ORDER BY y) AS p FROM s) SELECT c_mktsegment, round(min_by(m, y), 4) AS first, round(max_by(m, y), 4) AS last, coalesce(bool_and(m >= p), true) AS rising FROM g GROUP BY 1")
def ladders(spark, d):
    s = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("m"))
    g = s.withColumn("p", F.lag("m").over(Window.partitionBy("c_mktsegment").orderBy("y")))
    return g.groupBy("c_mktsegment").agg(F.round(F.min_by("m", "y"), 4).alias("first"), F.round(F.max_by("m", "y"), 4).alias("last"), F.coalesce(F.bool_and(F.col("m") >= F.col("p")), F.lit(True)).alias("rising"))


@query("o125_figure_percentiles", "WITH q AS (SELECT event_type, quantile_cont(value, [0.25, 0.5, 0.75, 0.95]) AS q FROM events GROUP BY 1) SELECT event_type, round(q[1], 6) AS p25, round(q[2], 6) AS p50, round(q[3], 6) AS p75, round(q[4], 6) AS p95 FROM q")
def figure_percentiles(spark, d):
    q = Q.quantiles(table(spark, d, "events"), ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return q.select("event_type", *[r6(F.col(c)).alias(c) for c in ("p25", "p50", "p75", "p95")])


@query("o125_histogram", "SELECT event_type, floor(value / 5)::INT AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def histogram(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 5).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("o125_density", """WITH g AS (SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) AS sd FROM events GROUP BY 1), c AS (SELECT event_type, value AS v, count(*) AS k FROM events GROUP BY 1, 2),
    w AS (SELECT *, sd * pow(n::DOUBLE, -0.2) AS h FROM g), x AS (SELECT c.event_type, v, k, n, h, point::INT AS point, low + (high - low) * point / 99 AS x FROM c JOIN w USING (event_type), range(100) r(point))
    SELECT event_type, point, round(x, 6) AS x, round(sum(k * exp(-0.5 * pow((x - v) / h, 2)) / (n * h * sqrt(2 * pi()))), 8) AS density FROM x GROUP BY event_type, point, x""")
def density(spark, d):
    return figures.density(table(spark, d, "events"), ["event_type"], "value").select("event_type", "point", r6(F.col("x")).alias("x"), F.round("density", 8).alias("density"))


@query("o125_matrix", """WITH m AS (SELECT l_linenumber AS line, avg(l_discount) AS discount, avg((l_returnflag = 'R')::INT) AS returned, avg((l_linestatus = 'O')::INT) AS opened FROM lineitem GROUP BY 1),
    z AS (SELECT line, 'discount' AS measure, discount AS v FROM m UNION ALL SELECT line, 'returned', returned FROM m UNION ALL SELECT line, 'opened', abs(opened - 0.5) FROM m), s AS (SELECT line, measure, v / max(abs(v)) OVER (PARTITION BY measure) AS v FROM z),
    t AS (SELECT line, measure, CASE WHEN measure = 'opened' THEN 1 - v ELSE v END AS v FROM s) SELECT line, measure, round(CASE WHEN measure = 'opened' THEN v / nullif(max(abs(v)) OVER (PARTITION BY measure), 0) ELSE v END, 5) AS value FROM t""")
def matrix(spark, d):
    flag = lambda c: F.avg(c.cast("int"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("line")).agg(F.avg("l_discount").alias("discount"), flag(F.col("l_returnflag") == "R").alias("returned"), flag(F.col("l_linestatus") == "O").alias("opened"))
    return figures.one_scale(rows, "line", ["discount", "returned", "opened"], {"opened": 0.5}).select("line", "measure", F.round("value", 5).alias("value"))


@query("o158_load_regression", f"WITH {C}, n AS (SELECT row_id, count(*) AS n FROM t GROUP BY 1), r AS (SELECT n, o_totalprice AS y FROM n JOIN orders ON o_orderkey = row_id), b AS (SELECT CASE WHEN n <= 2 THEN '1-2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS band, avg(y) AS m, count(*) AS k FROM r GROUP BY 1) SELECT band, k AS n, round(m, 3) AS mean, (SELECT round(regr_slope(y, n), 3) FROM r) AS slope, (SELECT round(corr(y, n), 6) FROM r) AS pearson FROM b")
def load_regression(spark, d):
    r = corpus(spark, d).select(F.col("row_id").alias("o_orderkey"), F.size("tokens").alias("n")).join(table(spark, d, "orders"), "o_orderkey").select("n", F.col("o_totalprice").alias("y"))
    line = F.broadcast(r.agg(F.round(F.regr_slope("y", "n"), 3).alias("slope"), r6(F.corr("y", "n")).alias("pearson")))  # one row
    band = F.when(F.col("n") <= 2, "1-2").when(F.col("n") <= 4, "3-4").otherwise("5+")
    return r.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 3).alias("mean")).crossJoin(line)


@query("o158_slope", f"""WITH {C}, n AS (SELECT row_id AS unit, count(*) AS x FROM t GROUP BY 1), q AS (SELECT unit, x, o_totalprice AS y FROM n JOIN orders ON o_orderkey = unit), {S.weights_sql("q", "unit", "load", 50)},
    b AS (SELECT r, (sum(w * x * y) / sum(w) - sum(w * x) / sum(w) * sum(w * y) / sum(w)) / (sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2) AS v FROM q JOIN weights USING (unit) GROUP BY 1)
    SELECT round((SELECT regr_slope(y, x) FROM q), 3) AS slope, round(quantile_cont(v, 0.025), 3) AS low, round(quantile_cont(v, 0.975), 3) AS high FROM b""")
def load_slope(spark, d):
    r = corpus(spark, d).select(F.col("row_id").alias("o_orderkey"), F.size("tokens").alias("x")).join(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("unit"), "x", F.col("o_totalprice").alias("y"))
    return S.slope(r, "x", "y", "unit", 50, "load").select(*[F.round(c, 3).alias(c) for c in ("slope", "low", "high")])


@query("o017_token_split", r"WITH k AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'E_' || p_size WHEN p_size % 3 = 1 THEN 'E_' || p_size || '_@_' || p_type ELSE 'X_' || p_size END AS token FROM part) SELECT token, nullif(regexp_extract(token, '^(E_\d+)(?:_@_(.+))?$', 1), '') AS code, nullif(regexp_extract(token, '^(E_\d+)(?:_@_(.+))?$', 2), '') AS value FROM k")
def token_split(spark, d):
    k = table(spark, d, "part").select(F.expr("CASE WHEN p_size % 3 = 0 THEN concat('E_', p_size) WHEN p_size % 3 = 1 THEN concat('E_', p_size, '_@_', p_type) ELSE concat('X_', p_size) END").alias("token")).distinct()
    return k.select("token", T.token_code(F.col("token")).alias("code"), T.token_value(F.col("token")).alias("value"))


@query("o022_depersonalise", r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace('Do you hurt yourself? Your ' || text, '(?i)\byourself\b', 'themselves', 'g'), '(?i)\byour\b', 'their', 'g'), '(?i)\byou\b', 'they', 'g') AS text FROM conversations")
def depersonalise(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.depersonalised(F.concat(F.lit("Do you hurt yourself? Your "), "text")).alias("text"))


@query("o024_bullets", "SELECT p_brand, string_agg('- ' || upper(left(p_type, 1)) || lower(substr(p_type, 2)), chr(10) ORDER BY p_type) AS text FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY 1")
def bullets(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t")).select("p_brand", T.bullets(F.col("t")).alias("text"))


@query("o025_narrative", """WITH k AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS i FROM (SELECT DISTINCT p_brand, p_type FROM part)),
    s AS (SELECT p_brand, i // 3 AS g, string_agg(p_type, '; ' ORDER BY i) AS t FROM k GROUP BY 1, 2)
    SELECT p_brand, string_agg('The patient ' || t || '.', ' ' ORDER BY g) AS text FROM s GROUP BY 1""")
def narrative(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t")).select("p_brand", T.sentences_of_three(F.col("t")).alias("text"))


#: Kinds of responses: good; unclosed with enough numbers; another key, so salvaged; braces in a string and a nested
#: object before the key; a wrong number of entries; a word among the numbers; unclosed with too few numbers.
RESPONSES = """CASE k % 7 WHEN 0 THEN 'so {"probabilities": [' || b || ']} tail } [9, 9, 9]' WHEN 1 THEN '{"probabilities": [' || b || ', 2, ' WHEN 2 THEN '{"scores": [' || b || ']}'
    WHEN 3 THEN '{"note": "a } b {", "more": {"x": [7]}, "probabilities": [' || b || ']}' WHEN 4 THEN '{"probabilities": [' || b || ', 1]}' WHEN 5 THEN '{"probabilities": [' || b || ', "none"]}' ELSE '{"probabilities": [1, 2' END"""
BODY = "(k - 10) || ', ' || (k % 5 - 2) || ', ' || (40 - k)"


@query("o030_probabilities", """WITH k AS (SELECT event_id, (props->>'$.k')::INT AS k FROM events),
    v AS (SELECT event_id, k % 7 AS z, greatest(k - 10, 0)::DOUBLE AS a, greatest(k % 5 - 2, 0)::DOUBLE AS b, greatest(40 - k, 0)::DOUBLE AS c FROM k), s AS (SELECT *, a + b + c AS s FROM v)
    SELECT event_id, CASE WHEN z >= 4 THEN NULL WHEN s > 0 THEN round(a / s, 6) ELSE round(1.0 / 3, 6) END AS first, CASE WHEN z >= 4 THEN NULL WHEN s > 0 THEN round(c / s, 6) ELSE round(1.0 / 3, 6) END AS last FROM s""")
def probabilities(spark, d):
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).withColumn("b", F.expr(BODY))
    p = rows.select("event_id", T.probabilities(F.expr(RESPONSES), 3).alias("p"))
    return p.select("event_id", *[r6(F.get("p", F.lit(i))).alias(c) for i, c in ((0, "first"), (2, "last"))])


@query("o032_index", "WITH k AS (SELECT event_id, (props->>'$.k')::INT AS k FROM events) SELECT event_id, CASE WHEN k < 49 THEN k END AS idx FROM k")
def index(spark, d):
    text = F.concat(F.lit("analysis {} assistantfinal"), F.lit('{"index": '), F.get_json_object("props", "$.k"), F.lit(".7} rest"))
    return table(spark, d, "events").select("event_id", T.index_in(T.after_last(text, "assistantfinal"), 49).alias("idx"))


@query("o031_weights", """SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 3) THEN NULL ELSE round(least(greatest(ln(least(greatest(p_retailprice * (p_size % 4), 1e-3), 1e3)), -7), 7), 6) END AS w,
    CASE p_size % 3 WHEN 0 THEN 2.302585::DOUBLE WHEN 1 THEN -0.693147::DOUBLE END AS band FROM part""")
def weights(spark, d):
    from tallyloom.functions.wording import ORDINAL_BANDS

    rows = table(spark, d, "part")
    text = F.expr("""concat('{"weights": [', p_retailprice * (p_size % 4), ', 1', if(p_size % 4 = 3, ', 2', ''), ']} end')""")
    words = F.expr("""concat('{"weights": ["', CASE p_size % 3 WHEN 0 THEN 'strongly_argues_for' WHEN 1 THEN 'weakly_argues_against' ELSE 'maybe' END, '"]}')""")
    return rows.select("p_partkey", r6(F.get(T.weights_in(text, 2), F.lit(0))).alias("w"), F.get(T.weights_in(words, 1, "ordinal", ORDINAL_BANDS), F.lit(0)).alias("band"))


BANDS = {"strong against": -3.0, "against": -1.0, "neutral": 0.0, "for": 1.0, "strong for": 3.0}


@query("o034_bands", "WITH b(k, v, i) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE, {i})" for i, (k, v) in enumerate(BANDS.items())) + ") SELECT event_id, min_by(k, struct_pack(d := abs(floor(value) / 10 - 2 - v), i := i)) AS band FROM events CROSS JOIN b GROUP BY event_id")
def bands(spark, d):
    return table(spark, d, "events").select("event_id", T.nearest_band(F.floor("value") / 10 - 2, BANDS).alias("band"))


@query("o035_targets", "SELECT p_partkey, round(least(greatest(exp(least(greatest(p_size / 4.0 - 6, -7), 7)), 1e-3), 1e3), 4) AS numeric FROM part")
def targets(spark, d):
    return table(spark, d, "part").select("p_partkey", T.numeric_target(F.col("p_size") / 4 - 6).alias("numeric"))


#: A note built of a document: headers with a slash and a hyphen, one twice, one that is too short.
NOTE = "'Chief Complaint:\n' || source || '  \nHistory/Past-Illness:\n' || coalesce(text, '') || '\nAge: 7\nChief Complaint: ' || lang || ' again \n'"
SECTION_SQL = r"""n AS (SELECT doc_id, replace({note}, '\n', chr(10)) AS note FROM documents),
    h AS (SELECT doc_id, regexp_extract_all(note, '(?m)^([A-Z][A-Za-z /\-]{{3,40}}):', 1) AS h, string_split_regex(note, '(?m)^([A-Z][A-Za-z /\-]{{3,40}}):') AS b FROM n)"""


def noted(spark, d):
    return table(spark, d, "documents").select("*", F.expr(NOTE.replace("\n", "\\n")).alias("note"))


@query("o038_sections", "WITH " + SECTION_SQL.format(note=NOTE.replace("\n", "\\n")) + r""" SELECT doc_id, len(list_distinct(h))::INT AS n_sections,
    trim(b[len(h) - list_position(list_reverse(h), 'Chief Complaint') + 2], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS complaint,
    length(trim(b[len(h) - list_position(list_reverse(h), 'History/Past-Illness') + 2], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))::INT AS n_history FROM h""")
def sections(spark, d):
    m = noted(spark, d).select("doc_id", T.sections(F.col("note")).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("doc_id", F.size("m").alias("n_sections"), at("Chief Complaint").alias("complaint"), F.length(at("History/Past-Illness")).alias("n_history"))


CUT_SQL = r"""string_split(regexp_replace(trim(regexp_replace({t}, '\s*\n\s*', ' ', 'g')), '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query("o039_sentences", "SELECT doc_id, len(list_filter(list_transform(" + CUT_SQL.format(t="coalesce(text, '')") + ", lambda s: trim(s)), lambda s: length(s) BETWEEN 25 AND 400))::INT AS n_sentences FROM documents")
def sentence_lengths(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.segments(F.coalesce("text", F.lit("")))).alias("n_sentences"))


@query("o041_cases", r"""WITH k AS (SELECT doc_id, source, text, len(regexp_extract_all(text, '_{2,}'))::INT AS n_deid, len(regexp_split_to_array(trim(text), '\s+')) AS n_words,
      list_filter(list_transform(""" + CUT_SQL.format(t="text") + r""", lambda s: trim(s)), lambda s: length(s) BETWEEN 25 AND 400) AS f FROM documents WHERE length(text) >= 400)
    SELECT doc_id AS note_id, left(regexp_replace(source || ' ' || source, '\s+', ' ', 'g'), 200) AS chief_complaint, len(f)::INT AS n_findings, f[1] AS first_finding, n_deid, length(text)::INT AS n_chars
    FROM k WHERE n_deid / greatest(n_words, 1) <= 0.02 AND len(f) BETWEEN 6 AND 20""")
def note_cases(spark, d):
    from tallyloom.operators import notes

    docs = table(spark, d, "documents")
    note = F.concat(F.lit("Chief Complaint: "), "source", F.lit("\n "), "source", F.lit("\nHistory of Present Illness:"), "text")
    # documents hold no header of their own
    out = notes.cases(docs.select(F.col("doc_id").alias("note_id"), note.alias("text")))
    return out.select("note_id", "chief_complaint", F.size("findings").alias("n_findings"), F.get("findings", F.lit(0)).alias("first_finding"), "n_deid", "n_chars")


@query("o040_mask_density", r"SELECT doc_id, round(len(regexp_extract_all(replace(coalesce(text, ''), 'the', '___'), '_{2,}')) / len(regexp_split_to_array(trim(replace(coalesce(text, ''), 'the', '___')), '\s+')), 6) AS density FROM documents")
def mask_density(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(T.mask_density(F.replace(F.coalesce("text", F.lit("")), F.lit("the"), F.lit("___")))).alias("density"))


@query("o042_candidates", "WITH k AS (SELECT conv_id, lower(trim(role)) AS c, min(turn) AS first FROM conversations GROUP BY 1, 2) SELECT conv_id, string_agg(c, ',' ORDER BY first) AS candidates FROM k GROUP BY 1 HAVING count(*) >= 2")
def candidates(spark, d):
    k = table(spark, d, "conversations").groupBy("conv_id", F.lower(F.trim("role")).alias("c")).agg(F.min("turn").alias("first"))
    kept = k.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "c"))).alias("z")).filter(F.size("z") >= 2)
    return kept.select("conv_id", F.array_join("z.c", ",").alias("candidates"))


@query("o043_screen", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' OR lower(p_name) LIKE '%red%'")
def screen(spark, d):
    return table(spark, d, "part").filter(F.lower("p_name").rlike("ring|bolt|red")).select("p_partkey")


@query("o044_replace", "SELECT o_orderkey, coalesce(n_name, 'none') AS nation FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3")
def replace(spark, d):
    nation = F.broadcast(table(spark, d, "nation").filter("n_regionkey < 3").select("n_nationkey", "n_name"))  # 25 nations
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("o045_json_path", "SELECT event_type, (props->>'$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_path(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("o145_stratified", f"""WITH {C}, e AS (SELECT row_id, label FROM t GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 5), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('s|' || row_id), row_id) AS k FROM e) WHERE k <= 40)
    SELECT row_id, label FROM k ORDER BY sha1('ss|' || row_id), row_id LIMIT 150""")
def stratified(spark, d):
    """Rows of two to five tokens, up to 40 of each label, 150 in all."""
    rows = corpus(spark, d).filter(F.size("tokens").between(2, 5)).select("row_id", "label")
    return S.stratified(rows, "label", "row_id", 40, most=150)


@query("o146_permutations", f"WITH {C}, h AS (SELECT row_id, j, token, sha1('p|' || row_id || '|' || j || '|' || token) AS h FROM t, range(4) r(j)), o AS (SELECT row_id, j, string_agg(token, ',' ORDER BY h) AS o FROM h GROUP BY 1, 2), k AS (SELECT row_id, string_agg(token, ',' ORDER BY token) AS k FROM t GROUP BY 1), f AS (SELECT row_id, o, min(j) AS j FROM o JOIN k USING (row_id) WHERE o <> k GROUP BY 1, 2) SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY j) - 1)::INT AS perm_index, o AS evidence_order FROM f")
def permutations(spark, d):
    return S.permutations(corpus(spark, d), "row_id", "tokens", 4).withColumn("evidence_order", F.array_join("evidence_order", ","))


@query("o155_group_split", "SELECT p_brand, count(*) AS n, CASE WHEN ('0x' || substr(sha1('g|' || p_brand), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS split FROM part GROUP BY 1 HAVING count(*) >= 10")
def group_split(spark, d):
    return S.group_split(table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n")).filter("n >= 10"), "p_brand", 0.3)


DRAWS = 2000


def bootstrap_sql(table: str, unit: str, value: str, seed: str) -> str:
    """SQL of S.bootstrap_mean over a column of two decimals, in hundredths: sums are whole numbers and the mean is rounded from them."""
    return f"""WITH u AS (SELECT {unit} AS unit, sum(round({value} * 100)::BIGINT) AS s, count(*) AS n FROM {table} GROUP BY 1), {S.weights_sql("u", "unit", seed, DRAWS)},
      b AS (SELECT r, sum(w * s)::DOUBLE / sum(w * n)::DOUBLE AS v FROM u JOIN weights USING (unit) GROUP BY 1)
      SELECT ((SELECT (sum(s) * 20000 + sum(n)) // (2 * sum(n)) FROM u)::DOUBLE / 1e6) AS mean, (SELECT sum(n)::BIGINT FROM u) AS n, (SELECT count(*) FROM u) AS n_clusters,
        round(quantile_cont(v, 0.025) / 100, 6) AS low, round(quantile_cont(v, 0.975) / 100, 6) AS high FROM b"""


def bootstrapped(rows, value, unit, seed):
    out = S.bootstrap_mean(rows.withColumn("hundredths", F.round(F.col(value) * 100).cast("long")), "hundredths", unit, DRAWS, seed)
    mean = F.expr("((CAST(total AS DECIMAL(28, 0)) * 20000 + n) div (2 * n)) / CAST(1e6 AS DOUBLE)")
    return out.select(mean.alias("mean"), "n", "n_clusters", r6(F.col("low") / 100).alias("low"), r6(F.col("high") / 100).alias("high"))


@query("o094_bootstrap", bootstrap_sql("customer", "c_custkey", "c_acctbal", "b"))
def bootstrap(spark, d):
    return bootstrapped(table(spark, d, "customer"), "c_acctbal", "c_custkey", "b")


@query("o112_cluster_bootstrap", bootstrap_sql("lineitem", "l_orderkey", "l_discount", "c"))
def cluster_bootstrap(spark, d):
    return bootstrapped(table(spark, d, "lineitem"), "l_discount", "l_orderkey", "c")


@query("o155_variants", f"""WITH {C}, b(lo, hi) AS (VALUES (0, 39), (40, 99)), n AS (SELECT token, lo, sex, count(*) AS n FROM t JOIN c USING (row_id) JOIN b ON age BETWEEN lo AND hi GROUP BY ALL)
    SELECT token, lo, sex, n, CASE WHEN ('0x' || substr(sha1('g|' || token), 1, 8))::BIGINT / 4294967296.0 < 0.3 THEN 'test' ELSE 'train' END AS split FROM n WHERE n >= 20""")
def split_variants(spark, d):
    """Counts by token, age band and sex; all variants of a token fall on one side."""
    rows = corpus(spark, d).select(F.explode("tokens").alias("token"), F.when(F.col("age") < 40, 0).otherwise(40).alias("lo"), "sex")
    return S.group_split(rows.groupBy("token", "lo", "sex").agg(F.count("*").alias("n")).filter("n >= 20"), "token", 0.3)


@query("o152_jobs", "SELECT o_orderkey, phase, 'a2' AS task, 'a2:' || o_orderkey || ':' || phase AS job_id FROM orders, (VALUES ('before'), ('after')) p(phase)")
def phase_jobs(spark, d):
    return jobs.phased(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", ["before", "after"], "a2")


@query("o152_weight_jobs", f"WITH {C} SELECT token, format, 'weight:' || format || ':' || token AS job_id FROM (SELECT DISTINCT token FROM t), (VALUES ('numeric'), ('logodds'), ('ordinal')) f(format)")
def weight_jobs(spark, d):
    return jobs.weight_jobs(corpus(spark, d).select(F.explode("tokens").alias("token")), ["numeric", "logodds", "ordinal"])


@query("o152_prior_jobs", f"""WITH {C}, b(lo, hi) AS (VALUES (0, 17), (18, 39), (40, 64), (65, 99)), s(sex) AS (VALUES ('F'), ('O'), ('X')), n AS (SELECT lo, sex, count(*) AS n FROM c JOIN b ON age BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT lo, hi, sex, coalesce(n, 0) AS n, 'prior:' || lo || ':' || hi || ':' || sex AS job_id FROM b CROSS JOIN s LEFT JOIN n USING (lo, sex)""")
def prior_jobs(spark, d):
    return jobs.prior_jobs(corpus(spark, d), [(0, 17), (18, 39), (40, 64), (65, 99)], ["F", "O", "X"])


@query("o152_inserted", f"""WITH {C}, k AS (SELECT row_id, list(token ORDER BY token) AS ts FROM t GROUP BY 1), p AS (SELECT *, floor(('0x' || substr(sha1('d|' || row_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (len(ts) + 1))::INT AS p FROM k)
    SELECT row_id, array_to_string(ts[1:p] || ['NEW'] || ts[p + 1:], ',') AS tokens FROM p""")
def inserted(spark, d):
    rows = corpus(spark, d)
    return rows.select("row_id", F.array_join(jobs.inserted(F.col("tokens"), F.lit("NEW"), F.col("row_id")), ",").alias("tokens"))


@query("o015_completeness", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def completeness(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_name")


@query("o126_filled_slots", "SELECT event_type, count(*) AS slots, count(*) FILTER (WHERE (props->>'$.k')::INT >= 50) AS filled FROM events GROUP BY 1")
def filled_slots(spark, d):
    slots = table(spark, d, "events").select("event_type", F.explode(F.map_entries(F.from_json("props", "map<string,int>"))).alias("e"))
    return slots.groupBy("event_type").agg(F.count("*").alias("slots"), F.count_if(F.col("e.value") >= 50).alias("filled"))
