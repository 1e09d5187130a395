"""Dictionaries of questions and conditions from JSON files with an object per name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "struct<question_en:string,is_antecedent:boolean,data_type:string,default_value:string,`possible-values`:array<string>,value_meaning:map<string,map<string,string>>>"
CONDITION = "struct<condition_name:string,`icd10-id`:string,severity:int,symptoms:map<string,string>,antecedents:map<string,string>>"


def entries(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{kind}>").alias("m"))
    return rows.select(F.explode("m").alias("name", "v"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """code, question, binary, antecedent, data_type, default_value, possible_values and meanings (English) of every question."""
    v = entries(spark, path, QUESTION)
    meanings = F.transform_values(F.coalesce("v.value_meaning", F.create_map().cast("map<string,map<string,string>>")), lambda _, m: F.try_element_at(m, F.lit("en")))
    return v.select(
        F.col("name").alias("code"), F.col("v.question_en").alias("question"), (F.col("v.data_type") == "B").alias("binary"), F.col("v.is_antecedent").alias("antecedent"),
        "v.data_type", "v.default_value", F.coalesce("v.possible-values", F.array().cast("array<string>")).alias("possible_values"), meanings.alias("meanings"),
    )


def conditions(spark: SparkSession, path: str) -> DataFrame:
    """label, icd10, severity and allowed (the codes of symptoms and antecedents) of every condition."""
    v = entries(spark, path, CONDITION)
    keys = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    return v.select(F.col("v.condition_name").alias("label"), F.col("v.icd10-id").alias("icd10"), "v.severity", F.array_union(keys("v.symptoms"), keys("v.antecedents")).alias("allowed"))


def filled_slots(spark: SparkSession, path: str) -> DataFrame:
    """One row: slots of the conditions' symptoms and antecedents, and how many of them hold anything."""
    v = entries(spark, path, CONDITION)
    slots = v.select(F.explode(F.concat(*[F.coalesce(F.map_values(f"v.{c}"), F.array().cast("array<string>")) for c in ("symptoms", "antecedents")])).alias("s"))
    filled = F.coalesce(F.regexp_replace("s", r"\s", ""), F.lit("")).isin("", "{}", "[]", "null")
    return slots.agg(F.count("*").alias("slots"), F.count_if(~filled).alias("filled"))
