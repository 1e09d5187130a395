"""Wording of questions and tokens, dictionaries, responses and their store."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import wording as W
from tallyloom.sources import dictionaries, responses


def said(spark, questions):
    rows = spark.createDataFrame(list(enumerate(questions)), "i int, q string").select("i", W.declarative(F.col("q")).alias("s"))
    return [r.s for r in rows.orderBy("i").collect()]


def test_questions_become_statements(spark):
    cases = {
        "Do you have a fever?": "has a fever",
        "Did you lose weight?": "lost weight",
        "Did you try it?": "tried it",
        "Did your cheeks turn red?": "their cheeks turn red",
        "Do you cough a lot?": "coughs a lot",
        "Do you wash often?": "washes often",
        "Do you carry loads? ": "carries loads",
        "Do you regularly drink coffee?": "regularly drinks coffee",
        "Have you ever had it??": "has ever had it",
        "have you traveled far?": "has travelled far",
        "Are you consulting because you have pain?": "is consulting because they have pain",
        "Are you dizzy today?": "is dizzy today",
        "Have you vomited?": "has vomited",
        "Is your nose blocked?": "their nose blocked",
        "In the last month, have you been in contact with someone?": "in the last month has been in contact with someone",
        "Characterize your pain:": None,
        "": None,
    }
    assert said(spark, list(cases)) == list(cases.values())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("kb")
    questions = {
        "E_1": {"question_en": "Do you have your keys?", "is_antecedent": True, "data_type": "B", "default_value": 0, "possible-values": [], "value_meaning": {}},
        "E_2": {"question_en": "How intense is the pain?", "is_antecedent": False, "data_type": "C", "default_value": 0, "possible-values": [0, 1], "value_meaning": {}},
        "E_3": {"question_en": "Where does it hurt you?", "is_antecedent": False, "data_type": "M", "default_value": "V_1", "possible-values": ["V_1"], "value_meaning": {"V_1": {"fr": "nulle part", "en": "nowhere"}}},
        "E_204": {"question_en": "Have you traveled out of the country in the last 4 weeks?", "is_antecedent": True, "data_type": "C", "default_value": "N", "possible-values": ["N"], "value_meaning": {"N": {"en": "N"}}},
    }
    conditions = {"x": {"condition_name": "X", "icd10-id": "a1", "severity": 2, "symptoms": {"E_1": {}, "E_2": {"p": 0.5}}, "antecedents": {"E_1": {}}}, "y": {"condition_name": "Y", "icd10-id": "b", "severity": 5, "symptoms": {}, "antecedents": {}}}
    (at / "q.json").write_text(json.dumps(questions, indent=1))
    (at / "c.json").write_text(json.dumps(conditions))
    return at


def test_dictionaries_and_phrases(spark, files):
    kb = dictionaries.questions(spark, str(files / "q.json"))
    rows = {r.code: r for r in kb.collect()}
    assert rows["E_1"].binary and rows["E_1"].antecedent and rows["E_3"].meanings == {"V_1": "nowhere"} and rows["E_2"].possible_values == ["0", "1"]
    tokens = spark.createDataFrame([("E_1", None), ("E_2", "7"), ("E_3", "V_1"), ("E_3", "V_9"), ("E_204", "N"), ("E_77", None)], "code string, value string")
    got = {(r.code, r.value): (r.bullet, r.prose) for r in W.finding_phrases(tokens, kb).collect()}
    assert got["E_1", None] == ("has their keys",) * 2 and got["E_2", "7"] == ("pain intensity, 0-10: 7", "rates the pain intensity, out of 10, at 7")
    assert got["E_3", "V_1"] == ("reports Where does it hurt they (nowhere)",) * 2 and got["E_3", "V_9"][0].endswith("(V_9)")
    assert got["E_204", "N"] == (W.NOT_TRAVELLED,) * 2 and got["E_77", None][0] in (None, "reports ")
    assert {r.code for r in W.unmatched(kb).collect()} == {"E_3"}
    told = tokens.join(kb, "code").select("code", "value", W.described(F.col("question"), F.col("binary"), F.col("value"), F.col("meanings")).alias("d"))
    assert {(r.code, r.value): r.d for r in told.collect()}["E_1", None] == "Do you have your keys? Yes"
    known = {r.label: (r.icd10, r.severity, sorted(r.allowed)) for r in dictionaries.conditions(spark, str(files / "c.json")).collect()}
    assert known == {"X": ("a1", 2, ["E_1", "E_2"]), "Y": ("b", 5, [])}
    assert tuple(dictionaries.filled_slots(spark, str(files / "c.json")).first()) == (3, 1)


def test_prompts(spark):
    names = F.array(F.lit("flu"), F.lit("cold"))
    who = W.person(F.lit(40), F.lit("M"))
    m = spark.range(1).select(W.prompt(names, who, F.lit("- Fever"), "Give {n} scores.", F.array(F.lit(0.25), F.lit(0.75))).alias("m")).first().m
    assert [x.role for x in m] == ["system", "user"]
    assert m[1].content == "Candidates:\n\n0. flu\n1. cold\n\nBase rates in the order of the list: 0.2500, 0.7500\n\nPatient: A 40-year-old man\n\n- Fever\n\nGive 2 scores."


def test_store_of_responses(spark, tmp_path):
    rows = [("m1", "a1", "i1", [0.2, 0.8], True, None, '{"case_id": "c1", "k": 3}'), ("m1", "a1", "i2", None, False, 'x {"probabilities": [1, 1]}', '{"case_id": "c2", "z": "q"}'), ("m1", "a1", "i3", None, False, "nothing", None), ("m2", "a1", "i4", [1.0, 0.0], True, None, "{}")]
    df = spark.createDataFrame(rows, "model_key string, task string, item_id string, parsed array<double>, valid boolean, raw_text string, meta string")
    at = str(tmp_path / "store")
    df.write.partitionBy("model_key", "task").parquet(at)
    got = {r.item_id: r for r in responses.load(spark, at, "m1", "a1").collect()}
    assert set(got) == {"i1", "i2", "i3"} and (got["i1"].case_id, got["i1"].k, got["i1"].z) == ("c1", "3", None) and got["i2"].z == "q" and got["i3"].case_id is None
    typed = responses.load(spark, at, "m1", "a1", "k int")
    assert {r.item_id: r.k for r in typed.collect()} == {"i1": 3, "i2": None, "i3": None}
    fixed = {r.item_id: (r.valid, r.parsed) for r in responses.repaired(df, 2).collect()}
    assert fixed == {"i1": (True, [0.2, 0.8]), "i2": (True, [0.5, 0.5]), "i3": (False, None), "i4": (True, [1.0, 0.0])}


def test_drift(spark):
    a = spark.createDataFrame([("x", "r1"), ("x", "r1"), ("y", "r2"), ("z", None), ("gone", "r5")], "hf_id string, revision string")
    b = spark.createDataFrame([("x", "r1"), ("y", "r3"), ("z", "r4")], "hf_id string, revision string")
    assert {r.hf_id: r.moved for r in responses.drift(a, b).collect()} == {"x": False, "y": True, "z": False, "gone": True}
