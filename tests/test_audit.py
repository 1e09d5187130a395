"""Audit queries on small tables against plain Python."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tallyloom.plans import catalog

Q = catalog.QUERIES


def test_depersonalise_takes_the_whole_text(spark, tmp_path):
    texts = ["x" * 70 + " are you sure of your answer, do it yourself", "You", "", None]
    rows = [(k, 0, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id int, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = {}
    for k, t in enumerate(texts):
        x = None if t is None else "Do you hurt yourself? Your " + t
        for old, new in (("your", "their"), ("yourself", "themselves"), ("you", "they")):
            x = x and re.sub(rf"\b{old}\b", new, x, flags=re.I)
        want[k] = x
    assert {r.conv_id: r.text for r in Q["o022_depersonalise"](spark, str(tmp_path)).collect()} == want
    assert want[0].endswith("are they sure of their answer, do it themselves")


def poisson(seed, replicate, unit):
    """The rule of draws: 32 bits of the unit's SHA-1 mixed with the replicate's number, read as a Poisson number of mean 1."""
    x = int(hashlib.sha1(f"{seed}|{unit}".encode()).hexdigest()[:8], 16) ^ (replicate * 0x7FEB352D) % 2**32
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
    u = ((x >> 16) ^ x) / 2**32
    return sum(u >= sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(9))


def test_bootstrap_draws_every_customer_when_keys_have_gaps(spark, tmp_path):
    rows = [(k * k + 7, float(k)) for k in range(150)] + [(7, 1000.0), (1_000_000, 5000.0), (1_000_000, 4000.0), (3, None)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    values = {}
    for k, x in rows:
        if x is not None:
            values.setdefault(k, []).append(x)
    means = []
    for r in range(2000):
        w = {k: poisson("b", r, k) for k in values}
        means.append(sum(w[k] * sum(v) for k, v in values.items()) / sum(w[k] * len(v) for k, v in values.items()))
    got = Q["o094_bootstrap"](spark, str(tmp_path)).first()
    every = [x for v in values.values() for x in v]
    assert (got.n, got.n_clusters) == (len(every), len(values)) and got["mean"] == pytest.approx(np.mean(every), abs=1e-5)
    assert [got.low, got.high] == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=1e-5)


def ranks(xs):
    order = sorted(xs)
    return [np.mean([i + 1 for i, y in enumerate(order) if y == x]) for x in xs]


def test_exact_quantiles_ranks_and_spearman(spark):
    from tallyloom.operators import quality as Q2

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, 1.5, 2.0, rng.gauss(0, 9)]), float(rng.randrange(20))) for _ in range(800)] + [("c", 7.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.low, r.mid, r.high) for r in Q2.quantiles(df, ["g"], "x", {"low": 0.0, "mid": 0.37, "high": 0.99}).collect()}
    for g in "abc":
        xs = [x for k, x, _ in rows if k == g and x is not None]
        assert got[g] == pytest.approx(np.quantile(xs, [0.0, 0.37, 0.99]))
    near = {r.g: r.value for r in Q2.nearest_rank(df, ["g"], "y", 0.01).collect()}
    assert near["c"] == 1.0 and near["a"] == sorted(y for k, _, y in rows if k == "a")[round(0.01 * (sum(k == "a" for k, _, _ in rows) - 1))]
    told = {r.g: r.spearman for r in Q2.spearman(df, ["g"], "x", "y").collect()}
    for g in "ab":
        both = [(x, y) for k, x, y in rows if k == g and x is not None]
        assert told[g] == pytest.approx(np.corrcoef(ranks([x for x, _ in both]), ranks([y for _, y in both]))[0, 1])
    assert Q2.quantiles(df.limit(0), ["g"], "x", {"low": 0.5}).count() == 0


def test_replicate_noise_counts_equal_vectors(spark):
    from tallyloom.operators import quality as Q2

    rows = [(1, [0.5, 0.5])] * 3 + [(1, [1.0, 0.0])] * 2 + [(2, [0.3, 0.7])] * 2 + [(3, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "case_id int, v array<double>")
    one = 0.5 * (0.5 * math.log2(0.5 / 0.75) + 0.5 * math.log2(0.5 / 0.25)) + 0.5 * math.log2(1 / 0.75)
    assert Q2.replicate_noise(df).first().mean_jsd == pytest.approx(6 * one / 11)
