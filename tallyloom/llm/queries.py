"""The queries of this subpackage, opN_<name>, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import classifier, clusters, counts, fingerprints, jaccard, language, packing, pieces, repetition, secrets, sharding, trie, url_rules

#: Rules of op2: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), byte_bpe())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.apply_rules(read(spark, sf_dir, "pages"), rules)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(read(spark, sf_dir, "documents")).drop("longest_repeat")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", counts.sample_edits())
    return counts.edited_counts(docs, byte_bpe())


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_documents(read(spark, sf_dir, "documents"), words=3, percent=90)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_edges", "n_cut")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.scored(read(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (op1_packing, op2_url_rules, op3_quality, op4_secrets, op5_repetition, op6_pieces, op7_jaccard, op8_counts, op9_sharding, op10_fingerprints, op11_trie, op12_clusters, op13_language)
}

_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES = {
    "op11_trie": trie.TRIE_SQL,
    "op12_clusters": clusters.cluster_sql(),
    "op7_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS k FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
    """,
    "op2_url_rules": rf"""
        WITH rules(rh, rp, v) AS (VALUES {_RULE_VALUES}),
        u AS (SELECT page_id, instr(coalesce(url, ''), '://') AS pos, coalesce(url, '') AS url FROM pages),
        h AS (SELECT page_id, CASE WHEN pos = 0 THEN '' ELSE substr(url, pos + 3) END AS rest FROM u),
        p AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM h),
        k AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p),
        m AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC, v DESC) AS k
              FROM k JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT k.page_id, k.host, k.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM k LEFT JOIN m ON m.page_id = k.page_id AND m.k = 1
    """,
    "op5_repetition": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
                     list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
        r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
        c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(5) AS x(j) GROUP BY doc_id),
        d AS (SELECT doc_id FROM c WHERE n >= 101),
        long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, md5(array_to_string(ws[i:i+100], ' ')) AS k
                   FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 99)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM d))) GROUP BY doc_id, k HAVING count(*) > 1),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
        SELECT *, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM long) AS kept FROM b
    """,
}
