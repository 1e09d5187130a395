"""Hand-computed vectors and responses."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_divergences(spark):
    p, q = vec(0.2, 0.3, 0.5), vec(0.2, 0.3, 0.5)
    assert value(spark, V.jsd(p, q)) == pytest.approx(0)
    assert value(spark, V.jsd(vec(1, 0), vec(0, 1))) == pytest.approx(1)
    assert value(spark, V.total_variation(vec(1, 0), vec(0, 1))) == 1
    assert value(spark, V.jsd(V.normalised(vec(2, 6)), vec(0.25, 0.75))) == pytest.approx(0)
    assert value(spark, V.kl(vec(0.5, 0.5), vec(0.7, 0.3))) == pytest.approx(0.12576938349798225)


def test_degenerate(spark):
    assert value(spark, V.normalised(vec(0, 0, 0, 0))) == [0.25] * 4
    assert value(spark, V.normalised(vec(-1, 1))) == [0, 1]
    assert value(spark, V.entropy(V.normalised(vec(0, 0, 0, 0)))) == 2
    assert not value(spark, V.informative(vec(*[1 / 49 + (5e-7 if i % 2 else -5e-7) for i in range(49)])))
    assert value(spark, V.top1(vec(0.4, 0.4, 0.2))) == 0
    assert value(spark, V.top_k(vec(0.4, 0.4, 0.2), 3)) == [0, 1, 2]
    assert value(spark, V.normalised(F.lit(None).cast("array<double>"))) is None


def test_responses(spark):
    assert value(spark, T.probabilities(F.lit('{"probabilities":[1,3]} \t\n'), 2)) == [0.25, 0.75]
    assert value(spark, T.probabilities(F.lit('{"probabilities":[1, 2, 1'), 3)) == [0.25, 0.5, 0.25]
    assert value(spark, T.probabilities(F.lit('{"probabilities":[1, 2, 1'), 4)) is None
    assert value(spark, T.probabilities(F.lit('{"probabilities":[0,0]}'), 2)) == [0.5, 0.5]
    assert value(spark, T.probabilities(F.lit('{"probabilities":[1,2,3]}'), 2)) is None
    assert value(spark, T.index_in(T.after_last(F.lit('x assistantfinal{"index": 28}'), "assistantfinal"), 49)) == 28
    assert value(spark, T.index_in(F.lit('{"index": 28}'), 20)) is None
    assert value(spark, T.weights(vec(1, 0), "numeric")) is None
    assert value(spark, T.weights(vec(9), "logodds")) == [7]
    assert value(spark, T.token_code(F.lit("E_55_@_V_29"))) == "E_55" and value(spark, T.token_value(F.lit("E_55_@_V_29"))) == "V_29"
    assert value(spark, T.token_code(F.lit("X_1"))) is None


def test_responses_with_nested_and_broken_objects(spark):
    p = lambda text, n=2: value(spark, T.probabilities(F.lit(text), n))
    assert p('x {"note": "a } b", "more": {"y": [1]}, "probabilities": [1, 3]} } [5, 5]') == [0.25, 0.75]
    assert p('{"scores": [1, 3]}') == [0.25, 0.75]  # closed, without the key: the first numbers
    assert p('{"probabilities": [1, "x"]}') is None and p('{"probabilities": [1]}') is None and p('{"probabilities": "no"}') is None
    assert p('{"probabilities": [-1, 2]}') == [0, 1] and p("no object at all") is None and p("") is None and p("[1, 1]") == [0.5, 0.5]
    assert p('{"probabilities": [1e400, 1]}') is None
    w = lambda text, n, kind="numeric", bands=None: value(spark, T.weights_in(F.lit(text), n, kind, bands))
    assert w('{"weights": [1, 2000]}', 2) == pytest.approx([0, 6.907755]) and w('{"weights": [1, 0]}', 2) is None and w('{"weights": [1]}', 2) is None
    assert w('{"weights": [9, -9]} tail', 2, "logodds") == [7, -7] and w('{"weights": [1, 2', 2) is None
    assert w('{"weights": ["a", "b"]}', 2, "ordinal", {"a": 1.5, "b": -1.5}) == [1.5, -1.5] and w('{"weights": ["a", "z"]}', 2, "ordinal", {"a": 1.5}) is None
    assert value(spark, T.index_in(F.lit('{"a": {"index": 1}, "index": 3.9}'), 5)) == 3 and value(spark, T.index_in(F.lit('{"index": "x"}'), 5)) is None


def test_notes(spark):
    note = "Intro\nChief Complaint: pain \nPast/Other-History:\n a\n\n b \nabc: no\nChief Complaint:\n worse\t\n"
    got = value(spark, T.sections(F.lit(note)))
    assert got == {"Chief Complaint": "worse", "Past/Other-History": "a\n\n b \nabc: no"}
    assert value(spark, T.sections(F.lit("no header"))) == {}
    body = "A first sentence that is long\n  enough to stay. Short one. Is this other one long enough too? (Yes it is long enough, I think.) x" + "y" * 400
    assert value(spark, T.segments(F.lit(body))) == ["A first sentence that is long enough to stay.", "Is this other one long enough too?"]
    from tallyloom.operators import notes

    history = "The patient has a pain that is new. " * 14
    rows = [(1, f"Chief Complaint: a  \n b\nHistory of Present Illness:\n{history}\nAllergies: x"), (2, "History of Present Illness: short."), (3, None), (4, f"History of Present Illness: {history} {'___ ' * 30}")]
    out = notes.cases(spark.createDataFrame(rows, "note_id int, text string")).collect()
    assert [(r.note_id, r.chief_complaint, len(r.findings), r.n_deid, r.n_chars) for r in out] == [(1, "a b", 14, 0, len(history.strip()))]


def test_narrative(spark):
    words = lambda *xs: F.array(*[F.lit(x) for x in xs])
    assert value(spark, T.sentences_of_three(words("has A", "is b", "c", "D"))) == "The patient has A; is b; c. The patient D."
    assert value(spark, T.sentences_of_three(F.array().cast("array<string>"), "She")) == ""


def test_conditioning(spark):
    from tallyloom.operators import conditioning as K

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "row_id int, label string")
    tokens = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "row_id int, label string, token string")
    items = spark.createDataFrame([(1, ["x"]), (2, []), (3, ["nope"]), (4, ["x", "y"])], "item_id int, evidence array<string>")
    got = {(r.item_id, r.label): (r.support, round(r.p, 4)) for r in K.conditioned(items, tokens, rows).collect()}
    assert got[1, "a"] == (2, 0.5) and got[2, "a"] == got[3, "a"] == (3, 0.6667) and got[4, "b"] == (0, 0.5)
    assert {(r.label, r.token): r.n_de for r in K.likelihoods(tokens, rows).collect()}["a", "x"] == 2


def test_queries_have_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    for name in ("o065_matches", "o084_tau_grid", "o137_split_shift", "o146_permutations"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
