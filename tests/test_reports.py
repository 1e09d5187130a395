"""Reports, items of a battery and arms on small tables against plain Python."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import battery as B, conditioning as K, reports as R, sampling as S


def test_update_summary(spark):
    g = np.random.default_rng(1)
    x, e = g.normal(size=40), np.abs(g.normal(size=40)) + 0.2
    y = np.where(np.arange(40) % 5 == 0, 0.0, 0.4 * x + 0.1 * g.normal(size=40))
    rows = [(i // 2, "ab"[i % 2], float(x[i]), float(y[i]), float(e[i])) for i in range(40)]
    df = spark.createDataFrame(rows, "item_id int, label string, true_delta double, stated_delta double, se double")
    r = R.update_summary(df, [], 40).first()
    w = 1 / e**2
    slope, intercept = np.polyfit(x, y, 1, w=1 / e)
    pred = intercept + slope * x
    r2 = 1 - (w * (y - pred) ** 2).sum() / (w * (y - (w * y).sum() / w.sum()) ** 2).sum()
    assert (r.n_items, r.n_points) == (20, 40) and [r.slope, r.intercept, r.r_squared] == pytest.approx([slope, intercept, r2])
    told = y != 0
    assert r.agreement == pytest.approx((np.sign(x) == np.sign(y))[told].mean()) and r.tie_rate == pytest.approx((~told).mean()) and r.low < r.slope < r.high
    assert {q.label for q in R.update_summary(df, ["label"], 5).collect()} == {"a", "b"}


def test_findings_come_by_severity(spark):
    row = spark.range(1)
    f = lambda check, level: R.finding(check, row, level, F.lit("x"))
    got = [(r.check, r["rank"]) for r in R.assembled([f("b", "info"), f("c", "critical"), f("a", "info")]).collect()]
    assert got == [("c", 1), ("a", 4), ("b", 4)]
    with pytest.raises(Exception, match="unknown severity"):
        R.assembled([f("a", "odd")]).collect()


def test_retention_and_gaps(spark):
    t = spark.createDataFrame([("m", 0.5, 0.4), ("m", 1.0, 0.2), ("m", 2.0, 0.4), ("n", 0.5, 0.1), ("n", 1.0, 0.3)], "model string, tau double, top1 double")
    got = {r.model: (r.best_tau, r.retention) for r in R.retention(t, "model").collect()}
    assert got == {"m": (0.5, pytest.approx(2)), "n": (1.0, pytest.approx(1))}
    g = R.gap_ratio(spark.createDataFrame([(1.0, 2.0), (3.0, 0.0)], "x double, y double"), "x", "y").first()
    assert (g.n, g.ratio, g.mean_ratio) == (2, 2.0, 0.5)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "xy"[i % 2], [t for k, t in enumerate("abcdef") if (i >> k) & 1]) for i in range(1, 64)]
    df = spark.createDataFrame(rows, "row_id int, label string, tokens array<string>")
    return rows, df, df.select("row_id", "label", F.explode("tokens").alias("token"))


def test_arms(spark, corpus):
    rows, df, tokens = corpus
    by = {}
    for r in B.arms(df.select("row_id", "tokens"), tokens, "row_id", 4, 3, 2, 2).collect():
        by.setdefault(r.row_id, {}).setdefault(r.arm, []).append(r)
    for i, _, ts in rows:
        own = by[i]
        orders = [tuple(r.evidence_order) for r in own["permutation"]]
        assert len(set(orders)) == len(orders) and all(sorted(o) == sorted(ts) for o in orders) and (tuple(ts) not in orders or len(ts) == 1 or len(orders) == 1)
        assert sorted(r.perm_index for r in own["permutation"]) == list(range(len(orders)))
        first = next(r.evidence_order for r in own["permutation"] if r.perm_index == 0)
        assert [r.evidence_order for r in own["retest"]] == [first] * 3 and [r.evidence_order for r in own["canonical"]] == [ts] * 2
        assert len(own["shuffled"]) == 2 and all(len(r.evidence_order) == len(ts) for r in own["shuffled"])
        have = Counter(t for _, _, xs in rows for t in xs)
        assert all(n <= have[t] for r in own["shuffled"] for t, n in Counter(r.evidence_order).items())
    notes = B.narrated(df.select("row_id", "tokens"), tokens, "row_id", 3, 2, 1).filter("row_id = 63").collect()
    assert sorted(r.arm for r in notes) == ["permutation"] * 3 + ["retest"] * 2 + ["shuffled"]
    assert all(r.evidence_order == list("abcdef") for r in notes if r.arm == "retest" or (r.arm == "permutation" and r.perm_index == 0))


def test_shuffled_arms_draw_without_replacement(spark, corpus):
    rows, df, tokens = corpus
    total = tokens.agg(F.count("*").alias("all"))
    n, sizes = total.first()["all"], {i: len(ts) for i, _, ts in rows}
    drawn = B.drawn_places(df.select("row_id", "tokens"), total, "row_id", 40).collect()
    assert len(drawn) == 40 * sum(k > 0 for k in sizes.values())
    for r in drawn:
        assert len(set(r.places)) == len(r.places) == sizes[r.row_id] and all(0 <= p < n for p in r.places)
    met = Counter(p for r in drawn for p in r.places)  # every place of the pool comes about as often
    assert len(met) > 0.9 * n and max(met.values()) < 8 * sum(met.values()) / n
    table = sorted((r.low, r.high, r.token) for r in B.pool(tokens).collect())
    have = Counter(t for _, _, xs in rows for t in xs)
    assert table[0][0] == 0 and table[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(table)) and all(h - l == have[t] for l, h, t in table)
    # a pool of one case's own tokens is drawn whole
    alone = spark.createDataFrame([(1, list("aabbc"))], "row_id int, tokens array<string>")
    one = tokens.limit(0).unionByName(alone.select("row_id", F.lit("x").alias("label"), F.explode("tokens").alias("token")), allowMissingColumns=True)
    got = [r.evidence_order for r in B.pooled(alone, one, "row_id", 30).collect()]
    assert len(got) == 30 and all(sorted(g) == list("aabbc") for g in got) and len(set(map(tuple, got))) > 5


def posterior(rows, ev):
    hit = [y for _, y, ts in rows if set(ev) <= set(ts)]
    return len(hit), [hit.count(k) / len(hit) if hit else 0.5 for k in "xy"]


def jsd(p, q):
    out = 0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        out += sum(v * math.log2(v / m) / 2 for v in (a, b) if v > 0)
    return out


def test_items_and_distractors(spark, corpus):
    rows, df, tokens = corpus
    base = df.select("row_id", "label", "tokens")
    for r in B.update_items(tokens, base, [1, 2], 4).collect():
        assert posterior(rows, r.context)[0] == r.support_before >= 4 and posterior(rows, [*r.context, r.new])[0] == r.support_after >= 4 and r.new not in r.context
        assert r.p_after == pytest.approx(posterior(rows, [*r.context, r.new])[1]["xy".index(r.label)])
    contexts = spark.createDataFrame([("a", ["a"]), ("bc", ["b", "c"])], "item_id string, evidence array<string>")
    got = {(r.item_id, r.token): (r.support, r.jsd) for r in K.redundancy(contexts, tokens, base, 4, 9).collect()}
    want = {}
    for name, ev in (("a", ["a"]), ("bc", ["b", "c"])):
        for t in set("abcdef") - set(ev):
            n, p = posterior(rows, [*ev, t])
            if n >= 4:
                want[name, t] = (n, pytest.approx(jsd(posterior(rows, ev)[1], p), abs=1e-9))
    assert got == want
    ratios = K.mixture_ratio(K.likelihoods(tokens, base))
    own = {r.row_id: r.token for r in B.distractors(base, tokens, base, ratios, 2, 4, 1.0).collect()}
    held = {i: ts for i, _, ts in rows}
    assert own and all(t not in held[i] and len(held[i]) >= 2 for i, t in own.items())


def test_evidence_of_unknown_and_repeated_tokens(spark, corpus):
    rows, df, tokens = corpus
    items = spark.createDataFrame([(1, ["a", "a", "zz"]), (2, ["zz"]), (3, ["a", "b", "c", "d", "e", "f"]), (4, [])], "item_id int, evidence array<string>")
    got = {(r.item_id, r.label): (r.n, r.support) for r in K.conditioned(items, tokens.unionByName(tokens.filter("row_id = 3")), df.select("row_id", "label", "tokens")).collect()}
    assert got[1, "y"] == (32, 32) and got[1, "x"] == (0, 32) and got[2, "x"] == got[4, "x"] == (31, 63) and got[3, "y"] == (1, 1)
    seen = K.matches(items, tokens, df).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in seen} == {1: 32, 2: 63, 3: 1, 4: 63}


def test_scales_against_a_loop(spark, corpus):
    rows, df, tokens = corpus
    weights = K.count_ratio(tokens, df)
    w = {(r.token, r.label): max(-7, min(7, r.log_ratio)) for r in weights.collect()}
    prior = {k: sum(y == k for _, y, _ in rows) / len(rows) for k in "xy"}
    sums = K.wide_sums(tokens, weights, ["label"])
    got = {(r.row_id, r.tau): r for r in K.scale_trace(sums, K.prior(df), "label", [0.0, 0.7], ["row_id"], top=2).collect()}
    whole = {r.tau: r for r in K.scale_trace(sums, K.prior(df), "label", [0.0, 0.7], top=2).collect()}
    for (i, y, ts), tau in itertools.product(rows, [0.0, 0.7]):
        z = np.array([math.log(prior[k]) + tau * sum(w[t, k] for t in ts) for k in "xy"])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        own = p["xy".index(y)]
        assert got[i, tau].nll == pytest.approx(-math.log(own)) and got[i, tau].top1 == int(p.argmax() == "xy".index(y)) == 1 - got[i, tau].error
        assert got[i, tau].entropy == pytest.approx(-(p * np.log2(p)).sum()) and got[i, tau].n == 1
    for tau, r in whole.items():
        assert r.n == len(rows) and r.nll == pytest.approx(np.mean([got[i, tau].nll for i, _, _ in rows])) and r.top2 == 1
    assert K.scale_trace(sums.withColumn("label", F.lit("other")), K.prior(df), "label", [0.7]).count() == 0
    best = K.with_fitted(K.scale_trace(sums, K.prior(df), "label", [0.0, 0.7]), [], "best").first().best
    assert best == 0.7
    turned = K.invariance(tokens.select("row_id", "token"), weights, K.prior(df), 4).agg(F.max("max_deviation"), F.max("mean_jsd"), F.count("*")).first()
    assert turned[0] < 1e-12 and turned[1] < 1e-12 and turned[2] == 63


def test_bootstrap_without_rows(spark):
    r = S.bootstrap_mean(spark.createDataFrame([], "k int, x double"), "x", "k", 5).first()
    assert r["mean"] is None and r.n == 0 and r.low is None
