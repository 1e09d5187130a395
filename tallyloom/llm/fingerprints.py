"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of words is hashed once; its top bits choose a bin and the least hash of a bin is kept. An empty bin
takes the value of the first filled one in a random order of all bins that depends on the empty bin alone (optimal
densification): bins are ordered by a hash of both, so the first filled one is that with the least hash. The low bits
of every bin are the fingerprint; equal low bits by chance are taken out of the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACES, dense_rank_table, narrowed, written

BINS, BIN_BITS, LOW_BITS = 128, 7, 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once for all its uses in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int) -> Column:
    """Sorted hashes of the runs of ``words`` words; of the whole sequence if it is shorter; empty without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    parts = F.transform(F.split(trimmed, r"[\x20\t\n\x0B\f\r]+", -1), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) >= words, F.sort_array(long)).otherwise(F.array(F.xxhash64(h)))

    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(let(parts, runs))


def fingerprint(text: Column, words: int = 5) -> Column:
    """Low bits of every bin as an array of BINS numbers; null without words."""
    place = lambda x: F.shiftright(x, 64 - BIN_BITS) + BINS // 2

    def least(h: Column) -> Column:
        return F.filter(h, lambda x, i: (i == 0) | (place(x) != place(F.get(h, i - 1))))

    def filled(m: Column) -> Column:
        own = F.map_from_arrays(F.transform(m, lambda x: place(x).cast("int")), m)

        def one(t: Column, b: Column) -> Column:
            first = F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(b, place(x)).alias("h"), x.alias("x"))))
            return F.coalesce(F.try_element_at(t, b), first["x"])

        return let(own, lambda t: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: one(t, b)))

    bins = let(shingle_hashes(text, words), lambda h: let(least(h), lambda m: F.when(F.size(m) == BINS, m).when(F.size(m) > 0, filled(m))))
    return F.transform(bins, lambda x: x.bitwiseAND(F.lit((1 << LOW_BITS) - 1)).cast("short"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard of the shingles behind two fingerprints; 1 if neither has words, 0 if one has none."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(BINS)
    chance = 2.0**-LOW_BITS
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), (equal - chance) / (1 - chance)))


def packed_hex(bins: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(bins, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""), F.lit(""))


def edited_fingerprints(docs: DataFrame, words: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likenesses.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document's: the one
    with the next smaller id, after the last the first. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A null text is empty; texts without words have an empty fingerprint. Null ids come last. Rows with the same id
    share their next document; where several rows have the next id, the edit takes the smallest text and near_next
    the smallest fingerprint. Every shingle of a very long text counts; its hashes are one array. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    own = narrowed(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    keys = written(own.groupBy("doc_id").agg(F.max(F.length("text")).alias("most"), F.count("*").alias("n")), "ids")
    positions, rows = dense_rank_table(keys, "doc_id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    positions = written(positions, "positions")
    turned = positions.select(F.col("doc_id").alias("next_id"), F.pmod(F.col("position") + 1, F.lit(max(rows, 1))).alias("position"))
    links = positions.join(turned, "position").select("doc_id", "next_id")
    links = written(links.join(keys.select(F.col("doc_id").alias("k"), "most"), F.col("doc_id").eqNullSafe(F.col("k"))).drop("k"), "links")
    repeated = bool(keys.filter("n > 1").limit(1).count())

    texts = own.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else own
    heads = links.select(F.col("doc_id").alias("for_id"), "next_id", "most").join(texts, F.col("next_id").eqNullSafe(F.col("doc_id")))
    heads = heads.select("for_id", "next_id", F.substring("text", F.lit(1), F.floor(F.col("most") / 2).cast("int")).alias("head"))
    both = own.join(heads, F.col("doc_id").eqNullSafe(F.col("for_id")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half))
    made = both.select("doc_id", "next_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), words).alias("own"), fingerprint(F.col("edited"), words).alias("new"))
    made = written(made, "fingerprints")
    after = made.select(F.col("doc_id").alias("after_id"), F.col("own").alias("after"))
    after = after.groupBy("after_id").agg(F.min("after").alias("after")) if repeated else after
    out = made.join(after, F.col("next_id").eqNullSafe(F.col("after_id")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        packed_hex(F.col("own")).alias("fingerprint"),
        packed_hex(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
