"""Queries on tables that are larger or less even than the given ones, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tallyloom.plans import catalog


def agrees(spark, folder, name):
    """Whether a query over the tables of a folder gives the rows of its SQL."""
    got = catalog.QUERIES[name](spark, str(folder))
    connection = duckdb.connect()
    for f in folder.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    columns = ", ".join(f'"{c}"' for c in got.columns)
    plain = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    want = connection.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall()
    return plain(got.collect()) == plain(want) and want


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Vectors of which a label's last run has one or a few rows, and parts that are all severe."""
    folder, g = tmp_path_factory.mktemp("uneven"), np.random.default_rng(3)
    labels = [label for label, n in enumerate((21, 45, 20)) for _ in range(n)]
    vectors = g.gamma(0.3, size=(len(labels), 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(labels)), pa.int64()), "label": pa.array(labels, pa.int32()), "embedding": pa.array(list(vectors), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array(range(64), pa.int64()), "p_size": pa.array([5] * 64, pa.int32())}), folder / "part.parquet")
    return folder


def test_instability_of_cases_with_one_permutation(spark, uneven):
    assert agrees(spark, uneven, "o097_instability")


def test_counts_of_short_and_long_sets_and_pairs(spark):
    """Short sets are counted by their subsets and longer ones by blocks; both give what plain Python does, and no pair of rows is made."""
    from itertools import combinations

    from tallyloom.operators import support as P

    g = np.random.default_rng(5)
    rows = [(i, "xy"[i % 2], sorted({f"t{k}" for k in g.integers(0, 14, size=n)})) for i, n in enumerate(g.integers(1, 16, size=300))]
    df = spark.createDataFrame(rows, "row_id int, label string, tokens array<string>")
    tokens = df.selectExpr("row_id", "label", "explode(tokens) AS token")
    evidence = [list(c) for n in (0, 1, 2, 3) for c in combinations([f"t{k}" for k in range(6)], n)]
    items = spark.createDataFrame(list(enumerate(evidence)), "item_id int, evidence array<string>")
    want = {}
    for i, e in enumerate(evidence):
        for _, label, ts in rows:
            if set(e) <= set(ts):
                want[i, label] = want.get((i, label), 0) + 1
    assert min(len(r[2]) for r in rows) <= P.FEW < max(len(r[2]) for r in rows)
    for given in (None, df):
        assert {(r.item_id, r.label): r.n for r in P.counts(items, tokens, given).collect()} == want
    pairs = {}
    for _, label, ts in rows:
        for a, b in combinations(ts, 2):
            pairs[label, a, b] = pairs.get((label, a, b), 0) + 1
    assert {(r.label, r.a, r.b): r.n for r in P.counted_pairs(P.counted_sets(tokens, df)).collect()} == pairs


def shuffles(df):
    """The shuffles in the plan of a query, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_arms_and_draws_shuffle_no_case_for_its_orders(spark):
    from tallyloom.operators import battery as B, comparison as M

    cases = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(4)], "row_id int, tokens array<string>")
    tokens = cases.selectExpr("row_id", "explode(tokens) AS token")
    assert shuffles(B.arms(cases, tokens, "row_id").filter("arm <> 'shuffled'")) == 0
    answers = spark.createDataFrame([(1, "permutation", i, i, [1.0, 0.0]) for i in range(4)], "case_id int, arm string, idx int, vec_id long, v array<double>")
    assert shuffles(M.ensemble_curve(answers, [1, 2], 20)) == 1


def test_kept_tables_follow_changed_files(spark, tmp_path):
    from tallyloom.operators.kept import kept

    path = str(tmp_path / "t.parquet")
    for n in (3, 5):
        pq.write_table(pa.table({"x": list(range(n))}), path)
        assert kept(spark.read.parquet(path)).selectExpr("sum(x) AS s").first()["s"] == sum(range(n))


def shop(folder, g, orders, brands):
    """Orders of 1 to 13 lines, whose first few brands are frequent."""
    folder.mkdir()
    keys, n = np.arange(orders) * 3 + 1, g.integers(1, 14, size=orders)
    order = pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array(g.integers(0, orders // 6 + 1, size=orders), pa.int64()), "o_orderstatus": ["F"] * orders,
                      "o_orderdate": pa.array([0] * orders, pa.timestamp("us")), "o_orderpriority": [f"{k}-P" for k in g.integers(1, 5, size=orders)]})
    pq.write_table(order, folder / "orders.parquet")
    lines = np.repeat(keys, n)
    pq.write_table(pa.table({"l_orderkey": pa.array(lines, pa.int64()), "l_partkey": pa.array(np.minimum(g.geometric(0.2, size=len(lines)), brands) - 1, pa.int64())}), folder / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array(range(brands), pa.int64()), "p_brand": [f"Brand#{k}" for k in range(brands)]}), folder / "part.parquet")
    return folder


def leaves(df):
    """The columns of what a query's plan reads."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return {frozenset(found.apply(i).output().apply(k).name() for k in range(found.apply(i).output().size())) for i in range(found.size())}


def test_divergences_from_shipped_vectors_are_made_once(spark, tmp_path):
    """The mean and the medians read one kept table of divergences; nothing before it is made anew for each of them."""
    g = np.random.default_rng(8)
    most, few = shop(tmp_path / "most", g, 400, 14), shop(tmp_path / "few", g, 12, 14)
    assert agrees(spark, most, "o143_oracle_vs_shipped")[0][0] > 50
    assert agrees(spark, few, "o143_oracle_vs_shipped") == [(0, None, None, None)]
    read = leaves(catalog.QUERIES["o143_oracle_vs_shipped"](spark, str(most)))
    assert all(columns <= {"support", "jsd", "k"} for columns in read)


def test_subsets_drawn_inside_the_row(spark):
    from tallyloom.operators import comparison as M

    rows = spark.createDataFrame([(i, [f"t{k}" for k in range(i % 6)]) for i in range(40)] + [(7, ["t0"])], "row_id int, tokens array<string>")
    tokens = rows.selectExpr("row_id", "explode(tokens) AS token")
    plain = lambda df: sorted(map(tuple, df.collect()))
    inside = M.drawn_subsets(tokens, [1, 3], rows=rows)
    assert plain(inside) == plain(M.drawn_subsets(tokens, [1, 3])) and plain(inside)


def test_vectors_are_not_made_anew_for_each_entry(spark, uneven):
    """The filter on informative vectors sinks below the projection that makes them: it holds a vector's making once for
    each branch, not inside what runs for every entry."""
    from tallyloom.functions import vectors as V

    assert agrees(spark, uneven, "o091_informative_only")
    plan = catalog.QUERIES["o091_informative_only"](spark, str(uneven))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line.count("embedding#") for line in plan.splitlines() if "exists(" in line]
    assert filters and max(filters) <= 2
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, [2.0, 2.0000001])], "i int, x array<double>")
    told = df.select("i", V.informative(V.normalised(df.x)).alias("told")).collect()
    assert {r.i: r.told for r in told} == {0: False, 1: True, 2: False, 3: False, 4: False}
