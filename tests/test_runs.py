"""Queries over embeddings use every vector: brute force on labels of more than one run."""

import itertools
import math

import numpy as np
import pytest

from tallyloom.plans import catalog

SIZES = {0: 47, 1: 20, 2: 7}
Q = catalog.QUERIES


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """The folder of a table of embeddings, and its normalised vectors of a label in the order of their ids."""
    g = np.random.default_rng(5)
    rows = [(100 * label + k, [float(x) for x in g.normal(size=64)], label) for label, n in SIZES.items() for k in range(n)]
    at = str(tmp_path_factory.mktemp("runs"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    by = {label: [] for label in SIZES}
    for _, e, label in rows:
        v = np.maximum(np.array(e, "f4").astype(float), 0)
        by[label].append(v / v.sum())
    return at, by


def cases(by, size):
    return {f"{label}|{k // size}": vs[k : k + size] for label, vs in by.items() for k in range(0, len(vs), size)}


def jsd(p, q):
    m = (p + q) / 2
    one = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 1e-12) / 2
    return one(p) + one(q)


def mean_jsd(vs):
    return np.mean([jsd(a, b) for a, b in itertools.combinations(vs, 2)])


def test_every_embedding_is_in_a_case(spark, made):
    at, by = made
    want = cases(by, 20)
    got = {r.case_id: r for r in Q["o051_mean_pairwise_jsd"](spark, at).collect()}
    assert got.keys() == want.keys()
    for c, vs in want.items():
        assert got[c].n_pairs == math.comb(len(vs), 2) and got[c].mean_jsd == pytest.approx(mean_jsd(vs), abs=2e-6)
    got = {r.case_id: r for r in Q["o091_order_effect"](spark, at).collect()}
    assert got.keys() == want.keys()
    for c, vs in want.items():
        assert got[c].jsd_permutation == pytest.approx(mean_jsd(vs[:10]), abs=2e-6)
        assert got[c].jsd_retest == (pytest.approx(mean_jsd(vs[10:16]), abs=2e-6) if len(vs) > 11 else None)


def test_ceiling_is_over_all_pairs_of_cases(spark, made):
    at, by = made
    firsts = [vs[0] for vs in cases(by, 20).values()]
    got = Q["o093_ceiling"](spark, at).first()
    assert got.n_pairs == 10 and got.ceiling == pytest.approx(mean_jsd(firsts), abs=2e-6)


def test_kendall_scores_every_pair_of_neighbours(spark, made):
    at, by = made
    want = {}
    for label, vs in by.items():
        for k, (a, b) in enumerate(itertools.pairwise(vs)):
            x, y = (np.sign(v[:, None] - v[None, :])[np.triu_indices(64, 1)] for v in (a, b))
            want[100 * label + k] = (x * y).sum() / math.sqrt((x != 0).sum() * (y != 0).sum())
    got = {r.vec_id: r.value for r in Q["o054_kendall"](spark, at).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_phases_and_displacement_use_every_run(spark, made):
    at, by = made
    want = {f"{c}|{k + 1}": jsd(vs[k], vs[k + 10]) for c, vs in cases(by, 20).items() for k in range(max(0, min(10, len(vs) - 10)))}
    got = {r.item_id: r.jsd for r in Q["o102_redundancy"](spark, at).collect()}
    assert got == pytest.approx(want, abs=2e-6)
    row, x = Q["o123_displacement"](spark, at).first(), list(want.values())
    assert row.n == len(x) == 30 and [row["mean"], row["median"], row["p95"]] == pytest.approx([np.mean(x), np.median(x), np.quantile(x, 0.95)], abs=2e-6)


def test_positions_use_every_run(spark, made):
    at, by = made
    code = [-1] * 4 + [0] * 4 + [1] * 4
    want, xs, ys = {}, [], []
    for c, vs in cases(by, 12).items():
        if len(vs) < 6:
            continue
        target, own = int(c.split("|")[0]), np.array(code[: len(vs)])
        p = np.clip(np.array(vs)[:, target], 1e-4, 1 - 1e-4)
        lo = np.log(p / (1 - p))
        centred = lo - lo.mean()
        xs.append(own)
        ys.append(centred)
        d = {(i, j): jsd(vs[i], vs[j]) for i, j in itertools.combinations(range(len(vs)), 2)}
        between = [np.mean([x for (i, j), x in d.items() if (own[i], own[j]) == z]) for z in sorted({(own[i], own[j]) for i, j in d if own[i] != own[j]})]
        spread = sum((own == k).sum() * centred[own == k].mean() ** 2 for k in set(own))
        tops = np.array(vs).argmax(1)
        modal = {np.bincount(tops[own == k]).argmax() for k in set(own)}
        want[c] = (np.mean([x for (i, j), x in d.items() if own[i] == own[j]]), np.mean(between), spread / (centred**2).sum(), lo[own == -1].mean(), len(modal) > 1)
    got = {r.case_id: (r.within, r.between, r.eta_squared, r.logodds_first, r.flip) for r in Q["o103_position_effect"](spark, at).collect()}
    assert got.keys() == want.keys() and len(got) == 7
    for c, x in want.items():
        assert got[c] == pytest.approx(x, abs=2e-6)
    row = Q["o104_position_slope"](spark, at).first()
    assert row.slope == pytest.approx(np.polyfit(np.concatenate(xs), np.concatenate(ys), 1)[0], abs=2e-6) and row.n_cases == 7 and row.low <= row.slope <= row.high
