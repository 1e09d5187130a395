"""Wording of questions and tokens, revisions and screening, over a dictionary that is derived from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as T, wording as W
from tallyloom.operators import quality as Q
from tallyloom.plans.bindings import query, table
from tallyloom.sources import responses as X

#: A question of each part by its size: five forms that rules word, and two that none does.
ASKED = """CASE p_size % 7 WHEN 0 THEN 'Do you have a ' || p_name || '?' WHEN 1 THEN 'Have you ever felt your ' || p_name || '??' WHEN 2 THEN 'Are your ' || p_name || 's old?'
  WHEN 3 THEN 'Is the ' || p_name || ' near you?' WHEN 4 THEN 'Do you carry your ' || p_name || '?' WHEN 5 THEN 'How intense is the pain?' ELSE 'Tell of your ' || p_name END"""
SAID = """CASE z WHEN 0 THEN 'has a ' || n WHEN 1 THEN 'has ever felt your ' || n WHEN 2 THEN 'their ' || n || 's old' WHEN 3 THEN 'the ' || n || ' near you' WHEN 4 THEN 'carries your ' || n END"""
BASE = f"d AS (SELECT p_partkey AS k, 'E_' || p_partkey AS code, p_name AS n, p_size % 7 AS z, p_size AS size, {ASKED} AS question, p_size % 7 < 5 AS yes_no FROM part)"
#: A value of a token: of every other open question the part's size, which has a meaning if it is even.
VALUE = "CASE WHEN NOT yes_no AND k % 2 = 0 THEN size::VARCHAR END"
SHOWN = f"CASE WHEN ({VALUE}) IS NULL THEN 'present' WHEN size % 2 = 0 THEN 'size ' || size ELSE ({VALUE}) END"


def dictionary(spark, d):
    """code, question, binary and meanings of each part."""
    size = F.col("p_size").cast("string")
    meanings = F.when(F.col("p_size") % 2 == 0, F.create_map(size, F.concat(F.lit("size "), size))).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("E_"), "p_partkey").alias("code"), F.expr(ASKED).alias("question"), (F.col("p_size") % 7 < 5).alias("binary"), meanings.alias("meanings"), size.alias("size"))


def valued(spark, d):
    value = F.when(~F.col("binary") & (F.col("p_partkey") % 2 == 0), F.col("size"))
    return dictionary(spark, d).withColumn("value", value)


@query("o019_values", f"WITH {BASE} SELECT k AS p_partkey, {SHOWN} AS shown FROM d")
def values(spark, d):
    return valued(spark, d).select("p_partkey", T.shown(F.col("value"), F.col("meanings")).alias("shown"))


@query("o020_described", f"WITH {BASE} SELECT k AS p_partkey, rtrim(question, '?') || '? ' || CASE WHEN yes_no THEN 'Yes' ELSE {SHOWN} END AS described FROM d")
def described(spark, d):
    return valued(spark, d).select("p_partkey", W.described(F.col("question"), F.col("binary"), F.col("value"), F.col("meanings")).alias("described"))


@query("o021_declarative", f"WITH {BASE} SELECT k AS p_partkey, {SAID} AS said FROM d")
def declarative(spark, d):
    return dictionary(spark, d).select("p_partkey", W.declarative(F.col("question")).alias("said"))


@query("o023_phrases", f"""WITH {BASE}, s AS (SELECT *, coalesce({SAID}, 'reports ' || rtrim(question, '?')) AS said, {SHOWN} AS shown FROM d)
    SELECT k AS p_partkey, replace(replace(CASE z WHEN 5 THEN 'pain intensity, 0-10: ' || shown WHEN 6 THEN said || ' (' || shown || ')' ELSE said END, 'your', 'their'), 'you', 'they') AS bullet,
      replace(replace(CASE z WHEN 5 THEN 'rates the pain intensity, out of 10, at ' || shown WHEN 6 THEN said || ' (' || shown || ')' ELSE said END, 'your', 'their'), 'you', 'they') AS prose FROM s""")
def phrases(spark, d):
    rows = valued(spark, d)
    return W.finding_phrases(rows.select("p_partkey", "code", "value"), rows.select("code", "question", "binary", "meanings")).select("p_partkey", "bullet", "prose")


@query("o026_unmatched", f"WITH {BASE} SELECT code, question FROM d WHERE z = 6")
def unmatched(spark, d):
    return W.unmatched(dictionary(spark, d))


@query("o027_prompts", f"""WITH {BASE}, m(task, ask) AS (VALUES ('posterior', '{W.SCORES}'), ('reasoned', '{W.REASONED}{W.SCORES}'), ('top', '{W.TOP_ANSWER}')),
    p AS (SELECT k, task, 'Candidates:' || chr(10) || chr(10) || '0. ' || n || chr(10) || '1. other' || chr(10) || chr(10)
        || CASE WHEN task = 'top' THEN '' ELSE 'Base rates in the order of the list: 0.2500, 0.7500' || chr(10) || chr(10) END || 'Patient: A ' || size || '-year-old ' || CASE WHEN k % 2 = 0 THEN 'man' ELSE 'woman' END || chr(10) || chr(10) || question || chr(10) || chr(10) || replace(ask, '{{n}}', '2') AS content FROM d, m)
    SELECT k AS p_partkey, task, content FROM p""")
def prompts(spark, d):
    """Three of the four prompts for a part with two candidates."""
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.expr(ASKED).alias("question"))
    names, who = F.array("p_name", F.lit("other")), W.person(F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "M").otherwise("F"))
    prior, findings = F.array(F.lit(0.25), F.lit(0.75)), F.col("question")
    made = {"posterior": W.posterior_prompt(names, who, findings, prior), "reasoned": W.reasoned_prompt(names, who, findings, prior), "top": W.top_prompt(names, who, findings)}
    user = F.explode(F.array(*[F.struct(F.lit(k).alias("task"), F.get(m, F.lit(1))["content"].alias("content")) for k, m in made.items()])).alias("z")
    return rows.select("p_partkey", user).select("p_partkey", "z.*")


@query("o035_target_kinds", """WITH v AS (SELECT p_partkey, least(greatest(p_size / 4.0 - 6, -7), 7)::DOUBLE AS x FROM part), b(k, v, i) AS (VALUES """ + ", ".join(f"('{k}', {v}::DOUBLE, {i})" for i, (k, v) in enumerate(W.ORDINAL_BANDS.items())) + """),
    o AS (SELECT p_partkey, min_by(k, struct_pack(d := abs(x - v), i := i)) AS band FROM v, b GROUP BY 1)
    SELECT p_partkey, round(least(greatest(exp(x), 1e-3), 1e3), 4) AS numeric, round(x, 3) AS logodds, band AS ordinal FROM v JOIN o USING (p_partkey)""")
def target_kinds(spark, d):
    x = F.col("p_size") / 4 - 6
    return table(spark, d, "part").select("p_partkey", T.numeric_target(x).alias("numeric"), T.logodds_target(x).alias("logodds"), T.ordinal_target(x, W.ORDINAL_BANDS).alias("ordinal"))


@query("o016_drift", """SELECT p_partkey AS hf_id, max(p_type) AS pinned, min(s.type) AS live, coalesce(max(p_type) <> '' AND max(p_type) IS DISTINCT FROM min(s.type), false) AS moved
    FROM part LEFT JOIN (SELECT l_partkey, CASE WHEN min(l_quantity) > 5 THEN max(p_type) ELSE 'ECONOMY' END AS type FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) s ON l_partkey = p_partkey GROUP BY 1""")
def drift(spark, d):
    """The type of a part against what its lines say: those of a part with a small line say ECONOMY."""
    pinned = table(spark, d, "part").select(F.col("p_partkey").alias("hf_id"), F.col("p_type").alias("revision"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("hf_id")).agg(F.min("l_quantity").alias("q")).join(pinned, "hf_id")
    return X.drift(pinned, lines.select("hf_id", F.when(F.col("q") > 5, F.col("revision")).otherwise("ECONOMY").alias("revision")))


#: Groups of parts of words, as a dictionary of questions is screened for them.
SCREENS = {"metal": ["bolt", "gear", "anvil"], "round": ["ring", "plate", "gear"], "hot": ["hot"], "none": ["smok", "pregnan"]}


@query("o043_screen_groups", "WITH g(name, part) AS (VALUES " + ", ".join(f"('{k}', '{p}')" for k, ps in SCREENS.items() for p in ps) + ") SELECT DISTINCT name AS screen, p_partkey FROM part JOIN g ON contains(lower(p_name), part)")
def screen_groups(spark, d):
    return Q.screened(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", SCREENS).select("screen", "p_partkey")

