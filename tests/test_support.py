"""Support of many sets and places in a group against plain counting."""

import random
from collections import Counter, defaultdict

import numpy as np

from tallyloom.operators import conditioning as K, quality as Q, ranges, sampling as S, support


def rows_of(n, seed=2):
    rng = random.Random(seed)
    rows = [(i, f"L{rng.randint(0, 3)}", sorted(rng.sample("abcdefghij", rng.randint(1, 6)))) for i in range(n)]
    return rows + [(n + i, "L1", ["a", "b"]) for i in range(300)] + [(n + 500, None, ["a", "j"])]  # many alike, and no label


def tables(spark, rows, items):
    tokens = spark.createDataFrame([(i, k, t) for i, k, ts in rows for t in ts + ts[:1]], "row_id int, label string, token string")
    return tokens, spark.createDataFrame(rows, "row_id int, label string, held array<string>"), spark.createDataFrame(items, "item_id string, evidence array<string>")


ITEMS = [("one", ["a"]), ("two", ["b", "a", "a"]), ("none", ["zz"]), ("part", ["zz", "c"]), ("empty", []), ("many", list("abcdef")), ("same", ["a", "b"])]


def test_support_counts_and_extensions(spark, monkeypatch):
    monkeypatch.setattr(support, "SETS", 7)  # of no effect in workers of other processes, but harmless
    rows = rows_of(200)
    tokens, corpus, items = tables(spark, rows, ITEMS)
    got = {(r.item_id, r.label): r.n for r in support.counts(items, tokens).collect()}
    want = Counter((i, k) for i, ev in ITEMS for _, k, ts in rows if set(ev) <= set(ts))
    assert got == dict(want)
    more = {(r.item_id, r.token, r.label): r.n for r in support.extended(items, tokens).collect()}
    assert more == dict(Counter((i, t, k) for i, ev in ITEMS for _, k, ts in rows if set(ev) <= set(ts) for t in ts if t not in ev))
    known = K.supports(items, tokens, corpus.filter("label IS NOT NULL")).collect()
    assert {r.item_id for r in known} >= {"none", "empty", "part"}  # unknown tokens are no evidence
    assert support.counts(items.limit(0), tokens).count() == 0 and support.counts(items, tokens.limit(0)).count() == 0


def test_blocks_of_few_sets():
    """Blocks hold the same counts however sets are cut into them; labels start new words; numbers have several digits."""
    rng = random.Random(4)
    sets = sorted((f"L{rng.randint(0, 4)}", sorted(rng.sample("abcdefg", rng.randint(0, 5))), rng.choice([1, 2, 7, 1000])) for _ in range(500))
    for size in (1, 63, 64, 200, 500):
        total = defaultdict(Counter)
        for at in range(0, 500, size):
            block = support.Block()
            for s in sets[at : at + size]:
                block.add(*s)
            met = support.Met(dict(zip(["labels", "starts", "words", "names", "bits", "planes"], block.row())))
            for ev in ([], ["a"], ["a", "b"], ["a", "b", "c"], ["a", "g"], ["zz"]):
                found = met.rows_of(ev)
                if found is not None:
                    for k, n in zip(met.labels, met.by_label(found)):
                        total[tuple(ev)][k] += int(n)
        for ev, counts in total.items():
            assert +counts == Counter({k: sum(n for l, ts, n in sets if l == k and set(ev) <= set(ts)) for k in counts}) - Counter()


def test_places(spark):
    rng = random.Random(9)
    values = [0.0, -0.0, 1e-12, -1e-12, 1e300, -1e300, float("inf"), float("nan"), None] + [rng.gauss(0, 1) for _ in range(400)] + [0.25] * 200 + [1.0 + i * 1e-13 for i in range(50)]
    rows = [(g, v) for g in ("x", "y") for v in values if g == "x" or v is None or v > 0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.value): (r.n, r.before, r["all"]) for r in ranges.placed(df, ["g"], "v").collect()}
    for g in ("x", "y"):
        own = sorted(v for k, v in rows if k == g and v is not None and v == v)
        assert {v: (own.count(v), own.index(v), len(own)) for v in set(own)} == {v: c for (k, v), c in got.items() if k == g}
    ids = spark.createDataFrame([(i % 3, i * 7) for i in range(1000)] + [(1, None)], "g int, id long")
    for g in range(3):
        own = [(r.id, r.rn) for r in ranges.numbered(ids, ["g"], "id", "rn").filter(f"g = {g}").orderBy("id").collect()]
        assert [n for _, n in own] == list(range(1, len(own) + 1)) and len(own) >= 333
    assert Q.quantiles(df.limit(0), [], "v", {"m": 0.5}).collect()[0:1] in ([], [(None,)])


def test_rank_correlation(spark):
    rng = random.Random(1)
    rows = [(rng.choice("pq"), rng.choice([1.0, 2.0, 3.5]), rng.randint(0, 50)) for _ in range(500)] + [("p", None, 1), ("q", 1.0, None), ("r", 1.0, 2)]
    import pandas as pd

    df = pd.DataFrame(rows, columns=["g", "x", "y"]).dropna()
    got = {r.g: r.spearman for r in Q.spearman(spark.createDataFrame(rows, "g string, x double, y int"), ["g"], "x", "y").collect()}
    for g in "pq":
        own = df[df.g == g]
        assert abs(got[g] - np.corrcoef(own.x.rank(), own.y.rank())[0, 1]) < 1e-9
    assert got["r"] is None


def test_many_replicates_of_a_unit(spark):
    """A unit's numbers come from its hash, whatever rows, groups or parts it meets."""
    rows = [(i, "g" if i % 3 else None, float(i % 10), None if i == 5 else 1) for i in range(400)]
    units = spark.createDataFrame(rows, "unit int, g string, s double, n int")
    codes = {r.unit: r.u for r in units.select("unit", S.unit_code("z", "unit").alias("u")).collect()}
    w = {u: S.times_drawn(np.array([c]), 3000)[0].astype(np.int64) for u, c in codes.items()}
    assert 0.9 < np.mean([x.mean() for x in w.values()]) < 1.1 and 0.9 < np.var(np.concatenate(list(w.values()))) < 1.1
    got = {(r.g, r.replicate): (r.s, r.n) for r in S.resampled(units, "unit", ["s", "n"], 3000, "z", ["g"]).collect()}
    for g in ("g", None):
        own = [(w[u], s, n or 0) for u, k, s, n in rows if k == g]
        s, n = sum(x * s for x, s, _ in own), sum(x * n for x, _, n in own)
        assert all(got[g, r] == (s[r], n[r]) for r in range(3000))
    assert len(got) == 6000
    r = S.bootstrap_mean(units, "s", "unit", 3000, "z").first()
    assert r.low < r["mean"] < r.high and r.n == 400 and r.total == sum(x[2] for x in rows)
