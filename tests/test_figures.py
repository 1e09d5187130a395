"""Figure reductions, last valid answers, drawn pairs, method tables, targets and prompts against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T, wording as W
from tallyloom.operators import arms, comparison as M, figures, quality as Q, ranges


def test_density(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 1)) for _ in range(80)] + [("a", 0.5)] * 9 + [("b", 1.0)] * 4 + [("c", 2.0), ("a", None), ("a", float("nan"))]
    got = figures.density(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 20).collect()
    own = np.array([v for g, v in rows if g == "a" and v is not None and v == v])
    h = own.std(ddof=1) * len(own) ** -0.2
    assert {r.g for r in got} == {"a"} and len(got) == 20  # groups without spread have none
    for r in got:
        x = own.min() + (own.max() - own.min()) * r.point / 19
        assert r.x == pytest.approx(x) and r.density == pytest.approx(np.exp(-(((x - own) / h) ** 2) / 2).sum() / (len(own) * h * math.sqrt(2 * math.pi)))
    assert figures.density(spark.createDataFrame(rows, "g string, v double").filter("g = 'a'"), [], "v", 5).count() == 5


def test_matrix_reference_extremes(spark):
    rows = spark.createDataFrame([("x", 2.0, 0.5), ("y", -4.0, 0.75), ("z", None, 0.3)], "k string, a double, b double")
    got = {(r.k, r.measure): r.value for r in figures.one_scale(rows, "k", ["a", "b"], {"b": 0.5}).collect()}
    assert got == {("x", "a"): 0.5, ("y", "a"): -1.0, ("x", "b"): 1.0, ("y", "b"): 0.0, ("z", "b"): pytest.approx(0.2)}
    curve = spark.createDataFrame([(2, 0.4), (8, 0.3), (1, 0.6)], "k int, residual double")
    got = {r.k: (r.reference, r.ratio) for r in figures.root_reference(curve).collect()}
    assert got[1] == (0.6, 1.0) and got[8] == (pytest.approx(0.6 / math.sqrt(8)), pytest.approx(0.3 / (0.6 / math.sqrt(8))))
    trace = spark.createDataFrame([("m", 0.1, 0.5, 2.0), ("m", 0.2, 0.7, 1.0), ("m", 0.3, 0.7, 1.0), ("n", 0.1, 0.1, 3.0)], "m string, tau double, top1 double, nll double")
    got = {r.m: (r.top1_at, r.top1, r.nll_at, r.nll) for r in figures.extremes(trace, ["m"], "tau", ["top1"], ["nll"]).collect()}
    assert got == {"m": (0.2, 0.7, 0.2, 1.0), "n": (0.1, 0.1, 0.1, 3.0)}


def test_last_valid_answer_wins(spark):
    answers = [(1, "before", True, 1, [0.5, 0.5]), (1, "before", True, 3, [0.2, 0.8]), (1, "before", False, 9, [0.9, 0.1]), (1, "after", True, 2, [0.6, 0.4]), (1, "after", True, 2, [0.6, 0.4]), (2, "before", True, 1, [0.1, 0.9]), (2, "after", False, 1, [0.1, 0.9]), (3, "after", True, 1, [0.1, 0.9])]
    df = spark.createDataFrame(answers, "item_id int, phase string, valid boolean, seq int, v array<double>")
    axis = spark.createDataFrame([(["x", "y"],)], "axis array<string>")
    got = {(r.item_id, r.label): r.stated_delta for r in M.stated_changes(df, axis, ["seq"]).collect()}
    logit = lambda p: math.log(p / (1 - p))
    assert got == {(1, "x"): pytest.approx(logit(0.6) - logit(0.2)), (1, "y"): pytest.approx(logit(0.4) - logit(0.8))}


def test_drawn_pairs_are_near_all_pairs(spark):
    g = np.random.default_rng(2)
    rows = [(f"c{i}", "permutation", 0, (v / v.sum()).tolist()) for i, v in enumerate(g.random((40, 6)) ** 3)] + [("u", "permutation", 0, [1 / 6] * 6), ("c1", "retest", 0, [1.0] + [0.0] * 5)]
    df = spark.createDataFrame(rows, "case_id string, arm string, idx int, v array<double>")
    every, drawn = arms.ceiling(df).first(), arms.drawn_ceiling(df, 4000).first()
    assert every.n_pairs == 780 and 3800 < drawn.n_pairs < 4000 and drawn.ceiling == pytest.approx(every.ceiling, rel=0.05)
    assert arms.drawn_ceiling(df.limit(0), 10).first().n_pairs == 0
    places = ranges.hash_placed(df.select("case_id").distinct(), "case_id", "p").collect()
    assert sorted(r.p for r in places) == list(range(len(places)))


def jsd(p, q):
    m = (np.array(p) + np.array(q)) / 2
    return sum(sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 1e-12) / 2 for x in (p, q))


def test_method_table_is_over_common_cases(spark):
    g = np.random.default_rng(7)
    vec = lambda: (lambda v: (v / v.sum()).tolist())(g.random(4) + 0.01)
    rows = [(c, "permutation", i, vec()) for c in range(6) for i in range(4 if c else 3)] + [(c, "retest", i, vec()) for c in range(5) for i in range(3 if c != 4 else 1)]
    df = spark.createDataFrame(rows, "case_id int, arm string, idx int, v array<double>")
    made = {(r.case_id, r.method): r for r in M.elicited_methods(df, [2, 3]).collect()}
    by = {(c, a): [v for k, b, _, v in rows if (k, b) == (c, a)] for c in range(6) for a in ("permutation", "retest")}
    assert set(made) == {(c, m) for c in range(1, 6) for m in ("direct", "ensemble_2")} | {(c, "self_consistency") for c in (1, 2, 3)}  # three permutations are too few, one retest too
    for c in (1, 2, 3):
        p, r = by[c, "permutation"], by[c, "retest"]
        assert made[c, "direct"].v == pytest.approx(p[0]) and made[c, "direct"].residual == pytest.approx(jsd(p[0], p[1]))
        assert made[c, "self_consistency"].v == pytest.approx(np.mean(r, axis=0)) and made[c, "self_consistency"].residual == pytest.approx(jsd(r[0], r[1])) and made[c, "self_consistency"].queries == 3
        assert made[c, "ensemble_2"].v == pytest.approx(np.mean(p[:2], axis=0)) and made[c, "ensemble_2"].residual == pytest.approx(jsd(np.mean(p[:2], axis=0), np.mean(p[2:], axis=0)))
    fused = [(c, "fusion", vec()) for c in (1, 3, 5)]
    answers = M.elicited_methods(df, [2]).unionByName(spark.createDataFrame([(c, m, v, 0.0, 0) for c, m, v in fused], "case_id int, method string, v array<double>, residual double, queries int"))
    cases = spark.createDataFrame([(c, c % 4, vec()) for c in range(6)], "case_id int, truth int, shipped array<double>")
    truth = {r.case_id: (r.truth, r.shipped) for r in cases.collect()}
    table = {r.method: r for r in M.method_table(answers, cases, top=2).collect()}
    assert set(table) == {"direct", "self_consistency", "ensemble_2", "fusion"} and all(r.n_cases == 2 for r in table.values())  # cases 1 and 3
    own = {c: v for c, _, v in fused}
    r = table["fusion"]
    assert r.residual == 0 and r.order_invariant == "exact" and r.auditable and r.jsd_to_shipped == pytest.approx(np.mean([jsd(truth[c][1], own[c]) for c in (1, 3)]))
    assert r.top1 == np.mean([int(np.argmax(own[c]) == truth[c][0]) for c in (1, 3)]) and r.top2 == np.mean([int(truth[c][0] in np.argsort(-np.array(own[c]))[:2]) for c in (1, 3)])
    assert table["ensemble_2"].order_invariant == "approx" and table["direct"].queries == 1 and not table["direct"].auditable


def test_targets_prompts_and_screens(spark):
    rows = spark.createDataFrame([(x,) for x in (-9.0, -0.7, 0.0, 1.6, 8.0)], "x double")
    got = [tuple(r) for r in rows.select(T.numeric_target(F.col("x")), T.logodds_target(F.col("x")), T.ordinal_target(F.col("x"), W.ORDINAL_BANDS)).collect()]
    assert [r[1] for r in got] == [-7.0, -0.7, 0.0, 1.6, 7.0] and got[0][0] == 0.001 and got[2][2] == "uninformative" and got[3][2] == "moderately_argues_for"
    names, who = F.array(F.lit("flu"), F.lit("cold")), W.person(F.lit(4), F.lit("F"))
    made = spark.range(1).select(*[W.weight_prompt(names, who, F.lit("has a fever"), k).alias(k) for k in W.WEIGHTS], W.reasoned_prompt(names, who, F.lit("x")).alias("r"), W.top_prompt(names, who, F.lit("x")).alias("t")).first()
    assert all('"weights" holds 2 values' in made[k][1].content and "has a fever" in made[k][1].content for k in W.WEIGHTS) and "strongly_argues_for" in made["ordinal"][1].content
    assert "First weigh" in made["r"][1].content and '"probabilities" holds 2 numbers' in made["r"][1].content and '"index"' in made["t"][1].content
    df = spark.createDataFrame([(1, "Smoker's cough"), (2, "Travelled for WORK"), (3, None)], "i int, q string")
    assert sorted((r.screen, r.i) for r in Q.screened(df, "q", {"smoke": ["smok"], "job": ["work", "occupation"], "none": []}).collect()) == [("job", 2), ("smoke", 1)]
