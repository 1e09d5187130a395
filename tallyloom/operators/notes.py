"""Cases from free notes: sections, sentences as findings, and what makes a note unusable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T

#: The sections that a case is made of.
HISTORY, COMPLAINT = "History of Present Illness", "Chief Complaint"


def cases(notes: DataFrame, least_chars: int = 400, fewest: int = 6, most: int = 20, most_masked: float = 0.02) -> DataFrame:
    """case_id, note_id, chief_complaint, findings (sentences), n_deid and n_chars of the usable notes (note_id, text).

    A note is usable if its history has ``least_chars`` characters, at most ``most_masked`` masks a word and between
    ``fewest`` and ``most`` findings. Notes without a history, or without text, are left out.
    """
    rows = notes.select("note_id", T.sections(F.col("text")).alias("s"))
    rows = rows.select("note_id", F.try_element_at("s", F.lit(HISTORY)).alias("history"), F.coalesce(F.try_element_at("s", F.lit(COMPLAINT)), F.lit("")).alias("complaint"))
    rows = rows.filter(F.length("history") >= least_chars).filter(T.mask_density(F.col("history")) <= most_masked)
    rows = rows.withColumn("findings", T.segments(F.col("history"))).filter(F.size("findings").between(fewest, most))
    case_id = F.substring(F.sha2(F.col("note_id").cast("string"), 256), 1, 16)
    return rows.select(case_id.alias("case_id"), "note_id", T.one_line(F.col("complaint")).alias("chief_complaint"), "findings", T.mask_count(F.col("history")).alias("n_deid"), F.length("history").alias("n_chars"))
