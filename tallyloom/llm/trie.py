"""Prefix trie of conversations by ROLLUP over positional turn ids.

A turn's id is 16 bytes of a SHA-256 of its role and text, so texts are never shuffled. A conversation is laid out in
blocks of WIDTH turns, a row each, with the ids as columns t1, t2, ... and ``prior``, the key of the node at which the
block before it ended. One GROUP BY block, prior, ROLLUP (t1, t2, ...) then aggregates all prefixes of all
conversations together, and grouping_id tells each group's depth. A node's key is a hash of prior and its ids, so the
next block's prior is known while a conversation is laid out, and no job waits for the one of the block before.

Sums over subtrees take a second ROLLUP. A node belongs to its smallest member, its owner; what a conversation owns is
the end of its path. So a subtree's sum is the sum, over its members, of what they own, less what the owner of its top
owns above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import HOT_PART, SPACES, hot_join, narrowed, tidied, written

#: Turns of a block, bytes of an id or key, and bytes of conversation ids that are hashed at once.
WIDTH, BYTES, PIECE = 8, 16, 1 << 20

IDS, WORDS = [f"t{i}" for i in range(1, WIDTH + 1)], [f"w{i}" for i in range(1, WIDTH + 1)]
BLOCKS = "conv_id long, block long, prior binary, size int, last boolean, " + ", ".join([f"{t} binary" for t in IDS] + [f"{w} long" for w in WORDS])


def digest(column: Column) -> Column:
    return F.substring(F.unhex(F.sha2(column, 256)), 1, BYTES)


def turn_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, id and words of every turn that has a conversation's id; null roles and texts count as empty."""
    rows = narrowed(conversations, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id IS NOT NULL")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(f"[^{SPACES}]+")).cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest(F.concat(F.sha2(role, 256), text).cast("binary")).alias("id"), words.alias("words"))


def own_turns(turns: DataFrame) -> DataFrame:
    """Turns as steps of their conversations, none left out."""
    return turns.select("conv_id", F.lit(1).alias("part"), "turn", "id", "words", F.lit(0).cast("long").alias("skip"))


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Steps of rebuilt conversations: the first h turns of conversation c - c % every, then c's own after its first h.

    h is the crc32 of c's decimal digits modulo most; % has the sign of c.
    """
    skip = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    heads = turns.filter(F.col("conv_id") % every == 0).withColumn("place", F.row_number().over(first)).filter(F.col("place") < most)
    heads = heads.select(F.col("conv_id").alias("source"), F.col("place").cast("long").alias("turn"), "id", "words")
    convs = turns.select("conv_id").distinct().withColumn("source", F.col("conv_id") - F.col("conv_id") % every).withColumn("skip", skip)
    taken = convs.filter("skip > 0").join(heads, "source").filter("turn <= skip")
    own = own_turns(turns).withColumn("skip", skip)
    return own.unionByName(taken.select("conv_id", F.lit(0).alias("part"), "turn", "id", "words", "skip"))


def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from steps in order of conversation, part and turn; only the block at hand is kept."""
    names, rows = [c.split()[0] for c in BLOCKS.split(", ")], []
    conv, prior, block, skipped, ids, words = None, b"", 0, 0, [], []

    def close(last: bool) -> None:
        pad = [None] * (WIDTH - len(ids))
        rows.append([conv, block, prior, len(ids), last, *ids, *pad, *words, *pad])

    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]]) for n, c in zip(names, BLOCKS.split(", "), strict=True)])
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for c, part, id_, n, skip in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "part", "id", "words", "skip")], strict=True):
            if c != conv:
                if conv is not None:
                    close(True)
                conv, prior, block, skipped, ids, words = c, b"", 0, 0, [], []
            if part and skipped < skip:
                skipped += 1
                continue
            if len(ids) == WIDTH:
                close(False)
                prior, block, ids, words = hashlib.sha256(prior + b"".join(ids)).digest()[:BYTES], block + 1, [], []
            ids.append(id_)
            words.append(n)
        if rows:
            yield made()
            rows = []
    if conv is not None:
        close(True)
        yield made()


def path_of(column: str = "prior") -> Column:
    """prior and the ids of a row, one after another: what a node's key is a hash of."""
    return F.concat(column, *[F.coalesce(t, F.lit(b"")) for t in IDS])


def rolled_up(blocks: DataFrame, measures: str) -> DataFrame:
    """The measures of every prefix that is a node: block, prior, t1, ..., level (turns of the block) and the measures."""
    ids = ", ".join(IDS)
    level = f"{WIDTH} - bit_count(grouping_id())"
    return blocks.sparkSession.sql(
        f"""
        SELECT block, prior, {ids}, {level} AS level, {measures} FROM {{blocks}} GROUP BY block, prior, ROLLUP ({ids})
        HAVING CASE WHEN {level} = 0 THEN block = 0 ELSE element_at(array({ids}), greatest({level}, 1)) IS NOT NULL END
        """,
        blocks=blocks,
    )


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, ids) for runs of rows with equal keys: decimal ids joined by commas, about PIECE bytes at most."""
    key, first, ids, size, out = None, 0, [], 0, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "ids"])
    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if k != key or size > PIECE:
                if ids:
                    out.append((key, first, ",".join(ids)))
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if out:
            yield made()
            out = []
    if ids:
        out.append((key, first, ",".join(ids)))
        yield made()


def hashed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends): SHA-256 of each key's pieces, joined by commas; a hash is carried on, pieces are not gathered."""
    key, running, out = None, None, []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["key", "ends"])
    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if k != key:
                if running:
                    out.append((key, running.digest()))
                key, running = k, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if out:
            yield made()
            out = []
    if running:
        out.append((key, running.digest()))
        yield made()


def ending_members(blocks: DataFrame) -> DataFrame:
    """key and ends (SHA-256) of the nodes at which conversations end.

    Conversations of one node are dealt to ranges of ids and joined to strings there; only the strings meet.
    """
    last = blocks.filter("last").select(digest(path_of()).alias("key"), "conv_id")
    pieces = last.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined_ids, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(hashed_runs, "key binary, ends binary")


def trie(steps: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    steps: what own_turns or with_shared_heads return. Every conversation passes through one task as a stream, in the
    order of its turns (null turns first, equal ones in the order of their ids); memory holds a block of it.
    """
    with tidied(steps.sparkSession) as kept:
        ordered = steps.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "id")
        blocks = written(ordered.select("conv_id", "part", "id", "words", "skip").mapInArrow(laid_out, BLOCKS), "blocks")
        most = ", ".join(f"max({w}) AS {w}" for w in WORDS)
        nodes = rolled_up(blocks, f"min(conv_id) AS conv_id, count(*) AS n_convs, max(size + CAST(NOT last AS INT)) AS reach, {most}")
        path = path_of()
        above = F.expr(f"substring(path, 1, length(path) - {BYTES})")
        parent = F.when((F.col("level") == 1) & (F.col("block") > 0), F.col("prior")).when(F.col("level") > 0, digest(above))
        words = F.coalesce(F.get(F.array(*WORDS), F.col("level") - 1), F.lit(0))
        nodes = nodes.withColumn("path", path).select(
            digest(F.col("path")).alias("key"), parent.alias("parent"), (WIDTH * F.col("block") + F.col("level")).alias("depth"), "conv_id", "n_convs", (F.col("reach") == F.col("level")).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * words).alias("saved")
        )
        nodes = written(nodes, "nodes")
        # what each conversation owns, summed over the members of every node
        owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves")).filter("saved > 0 OR leaves > 0")
        sums = rolled_up(blocks.join(owned, "conv_id"), "sum(saved) AS saved, sum(leaves) AS leaves").select(digest(path_of()).alias("key"), "saved", "leaves")
        down = Window.partitionBy("conv_id").orderBy("depth")
        over = F.coalesce(F.sum("saved").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        top = F.row_number().over(down) == 1
        # the owner of a node owns its parent too, unless the node is the topmost that it owns
        parts = [
            nodes.select("key", "depth", "conv_id", "n_convs", over.alias("over"), F.when(top, F.col("parent")).otherwise(F.col("key")).alias("ask")),
            sums,
            nodes.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children")),
            ending_members(blocks),
        ]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        whole = whole.groupBy("key").agg(*[F.max(c).alias(c) for c in whole.columns if c != "key"])
        whole = written(whole, "whole")
        n = whole.count()
        lookup = whole.select(F.col("key").alias("ask"), F.col("conv_id").alias("parent_conv_id"), (F.coalesce("children", F.lit(0)) * HOT_PART >= n).alias("hot"))
        found = hot_join(whole, lookup, ["ask"], "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        kept.append(
            written(
                found.select(
                    "conv_id",
                    "depth",
                    "parent_conv_id",
                    "n_convs",
                    zero("children").alias("n_children"),
                    zero("leaves").alias("n_leaves"),
                    (zero("saved") - F.col("over")).alias("saved_tokens"),
                    F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
                ),
                "trie",
            )
        )
    return kept[0]


def conversation_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of rebuilt conversations: each opens with up to ``most`` - 1 turns of conversation c - c % every.

    Null roles and texts are empty. A row without a conversation's id belongs to none and is left out; null turns come
    first. Repeated rows are turns of their own, and equal turns are ordered by their ids (hashes of role and text). A
    rebuilt conversation may have no turn: it ends at the root. Texts of any length and conversations of any number of
    turns are taken whole. An empty table has no root and gives no rows. Other columns are not read.
    """
    return trie(with_shared_heads(turn_rows(conversations), every, most))


CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len(s) + 1), lambda i: [ascii(s[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""

TRIE_SQL = rf"""
    WITH x AS MATERIALIZED (
        SELECT conv_id, turn, sha256(sha256(coalesce(role, '')) || coalesce(text, '')) AS x,
               len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS w
        FROM conversations WHERE conv_id IS NOT NULL),
    t AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS p FROM x),
    c AS MATERIALIZED (SELECT c, {CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM x)),
    r AS (SELECT c, 0 AS part, p, x, w FROM c JOIN t ON t.conv_id = c - c % 20 AND p <= h
          UNION ALL SELECT c, 1, p, x, w FROM c JOIN t ON t.conv_id = c AND p > h),
    s AS MATERIALIZED (
        SELECT c.c, coalesce(l.xs, []) AS xs, coalesce(l.ws, []) AS ws
        FROM c LEFT JOIN (SELECT c, list(x ORDER BY part, p) AS xs, list(w ORDER BY part, p) AS ws FROM r GROUP BY c) AS l USING (c)),
    m AS MATERIALIZED (
        SELECT c, d, len(xs) AS total, array_to_string(xs[1:d], '') AS k, CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], '') END AS up,
               CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w
        FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM s)),
    g AS MATERIALIZED (
        SELECT k, any_value(up) AS up, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(w) AS saved,
               sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = total), '')) AS ends
        FROM m GROUP BY k),
    b AS (SELECT up AS k, count(*) AS kids FROM g WHERE up IS NOT NULL GROUP BY up),
    f AS MATERIALIZED (SELECT g.*, coalesce(b.kids, 0) AS kids FROM g LEFT JOIN b USING (k)),
    u AS (SELECT a.k, sum(z.saved) AS saved, count(*) FILTER (WHERE z.kids = 0) AS leaves FROM f AS a JOIN f AS z ON starts_with(z.k, a.k) GROUP BY a.k)
    SELECT f.c AS conv_id, f.d::BIGINT AS depth, q.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, u.leaves AS n_leaves,
           u.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
    FROM f JOIN u USING (k) LEFT JOIN f AS q ON q.k = f.up
"""
