"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they stand. Weak candidates (short access identifiers, bare mixed-case keys,
endpoints) are reported only where complementary parts of a credential stand within ``scope`` code points. The
interval join behind that is an equi-join on (document, scope-wide bucket) with buckets reduced to their first and
last part of each role, so a document with many parts gives few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import narrowed, tidied, written

#: Kind, pattern, group whose length counts, least length. The first three are strong.
KINDS = [
    ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("identifier", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}", 0, 12),
    ("secret", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}", 0, 32),
    ("endpoint", r"https?://[A-Za-z0-9.-]+", 0, 12),
]
STRONG = ("assign", "access", "hex")
#: Part of a credential that a kind stands for.
ROLE = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "identifier", "identifier": "identifier", "endpoint": "endpoint"}
#: Parts that have to stand near a weak candidate.
NEEDS = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}


def choose(column: Column, values: dict[str, object]) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, and the text where any pattern is found in it; null elsewhere."""
    text = F.coalesce(F.col("text"), F.lit(""))
    any_kind = F.lit(False)
    for _, pattern, _, _ in KINDS:
        any_kind = any_kind | text.rlike(pattern)
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.when(any_kind, text).alias("hit"))


def candidates(marks: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, start, end of every match long enough. Positions are code points, end is exclusive.

    A pattern's matches and the stretches between them alternate, so running sums of their lengths are positions.
    """
    hits = marks.filter("hit is not null").dropDuplicates(["doc_id", "text_hash"])
    kinds = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.arrays_zip(
                    F.transform(F.regexp_extract_all("hit", F.lit(pattern), F.lit(0)), F.length).alias("size"),
                    F.transform(F.regexp_extract_all("hit", F.lit(pattern), F.lit(group)), F.length).alias("counted"),
                    F.transform(F.split("hit", pattern, -1), F.length).alias("gap"),
                ).alias("found"),
                F.lit(least).alias("least"),
            )
            for kind, pattern, group, least in KINDS
        ]
    )
    rows = hits.select("doc_id", "text_hash", F.explode(kinds).alias("k")).select("doc_id", "text_hash", "k.kind", "k.least", F.posexplode("k.found").alias("i", "m"))
    so_far = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(so_far)
    rows = rows.select("doc_id", "text_hash", "kind", "least", "m", end.cast("long").alias("end")).filter("m.size is not null and m.counted >= least")
    return rows.select("doc_id", "text_hash", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """Strong matches, and weak ones that overlap no strong one and have their complementary parts within scope."""
    key = ["doc_id", "text_hash"]
    found = found.withColumn("bucket", F.floor(F.col("start") / scope))
    strong = found.filter(F.col("kind").isin(*STRONG))
    # a weak match is covered if a strong one starts before its end and ends after its start: running maxima and minima tell
    place = Window.partitionBy(*key).orderBy("start", "end")
    is_strong = F.col("kind").isin(*STRONG)
    ends = F.max(F.when(is_strong, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(is_strong, F.col("start"))).over(place.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    weak = found.withColumn("reach", ends).withColumn("next", starts).filter(~is_strong)
    weak = weak.filter((F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))).drop("reach", "next")
    parts = strong.unionByName(weak).withColumn("role", choose(F.col("kind"), ROLE))
    reach = parts.groupBy(*key, "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    wanted = weak.withColumn("beside", F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    r = reach.select(F.col("doc_id").alias("r_doc"), F.col("text_hash").alias("r_hash"), F.col("bucket").alias("r_bucket"), "role", "first", "last")
    near = wanted.join(r, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_hash") == F.col("r_hash")) & (F.col("beside") == F.col("r_bucket")))
    near = near.filter((F.col("first") <= F.col("start") + scope) & (F.col("last") >= F.col("start") - scope))
    roles = near.groupBy(*key, "kind", "start", "end").agg(F.collect_set("role").alias("roles"))  # three roles at most
    needs = choose(F.col("kind"), {k: ",".join(v) for k, v in NEEDS.items()})
    told = roles.filter(F.size(F.array_except(F.split(needs, ","), "roles")) == 0)
    return strong.select(*key, "kind", "start", "end").unionByName(told.select(*key, "kind", "start", "end"))


def secret_spans(docs: DataFrame, scope: int = 400, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(marks, spans): marks has doc_id and text_hash of every row, spans doc_id, text_hash, kind, start and end.

    Rows with the same id and the same text share their spans; null ids are an id of their own and a null text is
    an empty one. Texts without a match, and empty tables, give no spans. Other columns are ignored.
    """
    with tidied(docs.sparkSession) as kept:
        marks = written(marked(narrowed(docs, doc_id=doc_id, text=text)), "marks")
        spans = written(linked(written(candidates(marks), "candidates"), scope), "spans")
        kept += [marks, spans]
    return marks.select("doc_id", "text_hash"), spans


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row; nulls and repeats as in secret_spans.

    A text of any length is searched whole; an empty table gives no rows.
    """
    marks, spans = secret_spans(docs, scope, doc_id, text)
    one = F.struct("start", choose(F.col("kind"), {k[0]: i for i, k in enumerate(KINDS)}).alias("order"), "kind", "end")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG]
    by = spans.groupBy(F.col("doc_id").alias("s_doc"), F.col("text_hash").alias("s_hash")).agg(
        *counts, F.collect_list(F.when(F.col("kind").isin(*STRONG), one)).alias("base"), F.collect_list(one).alias("all")
    )
    by = by.select("s_doc", "s_hash", *[f"n_{k}" for k in STRONG], joined(F.col("base")).alias("base"), joined(F.col("all")).alias("spans"))
    out = marks.join(by, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("text_hash") == F.col("s_hash")), "left")
    zero, empty = F.lit(0).cast("long"), F.lit("")
    return out.select(
        "doc_id", *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in STRONG], F.sha2(F.coalesce("base", empty), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans")
    )


def redacted(docs: DataFrame, scope: int = 400, mark: str = "[secret]", doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every span replaced by mark, and n_chars, if there, set to the new length. Other rows stay as they are.

    Spans that overlap or touch are replaced together. Rows with the same id and text change alike; null ids are an id of their
    own and null texts stay null. An empty table stays empty; the names of docs' columns are free.
    """
    with tidied(docs.sparkSession) as kept:
        _, spans = secret_spans(docs, scope, doc_id, text)
        before = F.max("end").over(Window.partitionBy("doc_id", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        block = F.sum(F.when(F.col("before") >= F.col("start"), 0).otherwise(1)).over(Window.partitionBy("doc_id", "text_hash").orderBy("start", "end"))
        merged = spans.withColumn("before", before).withColumn("block", block).groupBy("doc_id", "text_hash", "block").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        cuts = merged.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))  # the spans of one text
        kept.append(written(cuts, "cuts"))
    own, cut = F.col(f"d.`{text}`"), F.col("c.cut")
    out = docs.alias("d").join(kept[0].alias("c"), F.col(f"d.`{doc_id}`").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.coalesce(own, F.lit(""))) == F.col("c.text_hash")), "left")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cut, lambda s: s["end"]))
    starts = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.length(own).cast("long")))
    parts = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda p: F.substring(own, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    new = F.when(cut.isNotNull(), F.array_join(parts, mark)).otherwise(own)
    as_was = lambda c: F.col(f"d.`{c}`")
    columns = [new.alias(c) if c == text else F.when(cut.isNotNull(), F.length(new).cast(t)).otherwise(as_was(c)).alias(c) if c == n_chars else as_was(c) for c, t in docs.dtypes]
    return out.select(*columns)
