"""Exact n-gram Jaccard join by a token-group matrix.

1. Documents with equal texts form a class with one number. The most copied texts, a bounded list, send one document
   and get the smallest numbers, so that they become leaders.
2. A set is cut into blocks by the range of its shingles' hashes, as many as the most shingles in which two linked
   sets can differ, and some more. So linked sets agree on at least ``need`` non-empty blocks, whose hashes are the
   tokens of the matrix. Sets of neighbouring size classes share a way of cutting. A set with too many empty blocks
   also gives its first shingles as tokens, enough that two such sets share one.
3. Each class is checked against the leader (first class of a token) with which it shares most tokens; those that
   link form the first components. Large groups of near copies collapse here by one check each.
4. Classes whose tokens also lie with other components are put into groups of bounded size: a component that fills
   groups has groups of its own, the others share groups with what met the same leader. Each group stores the union of
   its members' tokens. A class takes the ``tokens - need + 1`` rarest of its tokens to find groups, for a group that
   shares ``need`` of them must hold one of these; it opens those with which it then shares ``need`` tokens in all.
   Of two groups only the earlier one's classes ask, so each two classes meet once.
5. In an open group, sketches bound the distance to each member. For each component there the nearest member is
   compared as a set first; other members only where the components have not become one by that.
6. Links join into components.

Sketches hold the parity of shingles in 1024 cells, twice as many for each doubling of sets above 2048 shingles; the
longer of two is folded onto the shorter. Two sketches differ in at most as many cells as the sets differ
in shingles, so they never hide a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import HOT_PART, hot_join, narrowed, tidied, written
from tallyloom.llm.graph import components

U = np.uint64
CELLS = 1024
#: Members of a group, on average at most; rows with one key that meet in one run of a task.
GROUP_ROWS = 96
CACHE_WORDS = 200_000
#: Bits of a token.
TOKEN_MASK = U((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lower-cased; of all words if there are fewer."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, U)
    h = np.fromiter(map(hashes().__getitem__, parts), U, len(parts))
    width = min(words, len(h))
    x = np.full(len(h) - width + 1, width, U)
    for k in range(width):
        x = mix(x + h[k : len(h) - width + 1 + k])
    return np.unique(x)


@lru_cache(maxsize=8)
def size_classes(percent: int) -> tuple[list[int], list[int]]:
    """First and last sizes of the classes: linked sets are in one class or in neighbouring ones."""
    first, last = [1], [100 // percent]
    while last[-1] < 1 << 40:
        first.append(last[-1] + 1)
        last.append(max(first[-1], 100 * first[-1] // percent))
    return first, last


def cutting(tag: int, percent: int) -> tuple[int, int]:
    """Blocks of a tag, and how many of them two linked sets have in common at least."""
    last = size_classes(percent)[1][tag]
    apart = (100 - percent) * 2 * last // (100 + percent)
    if not apart:
        return 1, 1
    need = 2 + int(2 * (apart + 1) * exp(-0.8 * last / (apart + 1)))
    return apart + need, need


def tokens(x: np.ndarray, tag: int, percent: int) -> tuple[np.ndarray, int]:
    """Tokens of a set under a tag, and how many of them a linked set's group has to share."""
    blocks, need = cutting(tag, percent)
    # block of a hash: its high 32 bits times the number of blocks, shifted back; sorted hashes give sorted blocks
    edges = np.searchsorted(((x >> U(32)) * U(blocks)) >> U(32), np.arange(blocks + 1, dtype=U))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(x + U(0x5851F42D4C957F2D)), dtype=U)])
    filled = np.flatnonzero(np.diff(edges))
    own = mix(sums[edges[filled + 1]] - sums[edges[filled]] + mix(filled.astype(U) + U(tag << 32)))
    empty = blocks - len(filled)
    if empty >= need:
        prefix = len(x) - -(-percent * len(x) // 100) + 1
        own = np.concatenate([own, mix(x[:prefix] ^ mix(np.array([tag], U) + U(0xD1B54A32D192ED03)))])
    return (own & TOKEN_MASK).view(np.int64), max(1, need - empty)


def sketch(x: np.ndarray) -> list[int]:
    n = CELLS
    while 2 * n < len(x):
        n *= 2
    cells = np.bincount((mix(x ^ U(0x2545F4914F6CDD1D)) % U(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64).tolist()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches of so many numbers: halves are laid over each other."""
    while sketches.shape[-1] > width:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few rows are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def token_sets(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """node, tag, need and tokens of every row of (node, text) with words, under both its tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = size_classes(percent)[1]
        for b in sliced(batches):
            rows: list[tuple[int, int, int]] = []
            found: list[np.ndarray] = []
            held = 0
            for node, t in zip(b.column("node").to_pylist(), b.column("text").to_pylist(), strict=True):
                x = shingles(t, words)
                if not len(x):
                    continue
                own = int(np.searchsorted(last, len(x)))
                for tag in (0, 1):
                    got, need = tokens(x, own + tag, percent)
                    rows.append((node, tag, need))
                    found.append(got)
                    held += len(got)
                if held > 300_000:
                    yield flat(rows, found)
                    rows, found, held = [], [], 0
            yield flat(rows, found)

    def flat(rows: list[tuple[int, int, int]], found: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int32)
        every = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
        arrays = [pa.array([x[k] for x in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))]
        return pa.RecordBatch.from_arrays([*arrays, every], names=["node", "tag", "need", "tokens"])

    return texts.mapInArrow(run, "node long, tag int, need int, tokens array<long>")


def counted_keys(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, other_hash, size and n, the number of distinct shingles, of every row."""
    id_type, plain = docs.schema["doc_id"].dataType.simpleString(), ["doc_id", "text_hash", "other_hash", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(shingles(t, words)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(b.column, plain), pa.array(n, pa.int64())], names=[*plain, "n"])

    return docs.select(*plain, "text").mapInArrow(run, f"doc_id {id_type}, text_hash long, other_hash long, size int, n long")


def most_apart(n1: Column, n2: Column, percent: int) -> Column:
    return F.floor((100 - percent) * (n1 + n2) / (100 + percent))


def may_link(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    for k in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")), k)
    # sizes of linked sets are near, so one sketch is at most twice the other; others say nothing here
    half = lambda s: F.zip_with(F.slice(s, F.lit(1), F.expr(f"size({s}) div 2")), F.slice(s, F.expr(f"size({s}) div 2 + 1"), F.expr(f"size({s}) div 2")), lambda x, y: x.bitwiseXOR(y))
    a = F.when(F.size("s_a") == 2 * F.size("s_b"), half("s_a")).otherwise(F.col("s_a"))
    b = F.when(F.size("s_b") == 2 * F.size("s_a"), half("s_b")).otherwise(F.col("s_b"))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))), F.lit(0), lambda s, x: s + x)
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (differ <= most_apart(F.col("n_a"), F.col("n_b"), percent))
    return pairs.filter(near)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have the Jaccard similarity asked for.

    b's set travels to a's; a node in many pairs is dealt out in runs of at most GROUP_ROWS rows on average.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("runs"))
    first = runs.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), F.lit(None).cast("long").alias("b"), "set")
    dealt = pairs.join(runs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("runs")).alias("run"))
    rest = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "run", "b", "set")
    rows = first.unionByName(rest).repartition("a", "run").sortWithinPartitions("a", "run", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U)
        for batch in sliced(batches):
            found: list[tuple[int, int]] = []
            for a, b, raw in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "set")), strict=True):
                x = np.frombuffer(raw, U)
                if b is None:
                    own = x
                    continue
                at = np.searchsorted(own, x)
                both = int((own[np.minimum(at, len(own) - 1)] == x).sum())
                if 100 * both >= percent * (len(own) + len(x) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def opened(queries: DataFrame, members: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """a, b, apart, own and other of a query and a member of its group, of the components own and other, whose sizes and
    sketches allow a link; apart counts the cells in which their sketches differ.

    queries: node, component and grp for each group that a node found, a written table; members: the same for each group;
    facts: node, n, sketch and asks (need and tokens under each tag). A group is opened for a query that shares need of
    its tokens under some tag with the union of its members' tokens. The queries of a group are dealt out in runs of
    GROUP_ROWS on average, each of which gets the group's members, a bounded number.
    """
    columns = ["grp", "run", "node", "component", "n", "sketch", "asks"]
    counts = written(queries.groupBy("grp").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    runs = counts.select("grp", F.ceil(F.col("n") / GROUP_ROWS).alias("runs"), (F.col("n") * HOT_PART >= total).alias("hot"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run")
    held = members.join(runs.drop("hot"), "grp").select("grp", every, "node", "component").join(facts, "node").withColumn("kind", F.lit(0))
    asking = hot_join(queries, runs, ["grp"]).select("grp", F.pmod(F.xxhash64("node"), F.col("runs")).alias("run"), "node", "component").join(facts, "node").withColumn("kind", F.lit(1))
    rows = held.unionByName(asking).repartition("grp", "run").sortWithinPartitions("grp", "run", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, table, union = None, [], None, []
        for batch in sliced(batches):
            out: list[tuple[int, int, int, int, int]] = []
            asks, cells = batch.column("asks"), batch.column("sketch")
            # lists stay arrays: where a row's asks, an ask's tokens and a row's sketch begin
            ask_at, need = asks.offsets.to_numpy(), asks.values.field("need").to_numpy()
            lists = asks.values.field("tokens")
            token_at, token = lists.offsets.to_numpy(), lists.values.to_numpy()
            cell_at, cell = cells.offsets.to_numpy(), cells.values.to_numpy()
            plain = [batch.column(k).to_pylist() for k in ("grp", "run", "node", "component", "n", "kind")]
            for i, (grp, part, node, component, n, kind) in enumerate(zip(*plain, strict=True)):
                if (grp, part) != key:
                    key, held, table, union = (grp, part), [], None, []
                if not kind:
                    held.append((node, component, n, cell[cell_at[i] : cell_at[i + 1]].copy()))
                    if ask_at[i] < ask_at[i + 1]:
                        union.append(np.unique(token[token_at[ask_at[i]] : token_at[ask_at[i + 1]]]))
                    continue
                if len(union) > 1:
                    union = [np.unique(np.concatenate(union))]
                if not union:
                    continue
                (known,) = union

                def shares(j: int) -> bool:
                    x = token[token_at[j] : token_at[j + 1]]  # noqa: B023
                    return int((known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x).sum()) >= need[j]  # noqa: B023

                if not any(map(shares, range(ask_at[i], ask_at[i + 1]))):
                    continue
                if table is None:
                    by_width: dict[int, list] = {}
                    for m in held:
                        by_width.setdefault(len(m[3]), []).append(m)
                    table = [[np.array([m[k] for m in ms], np.int64) for k in range(4)] for ms in by_width.values()]
                own = cell[cell_at[i] : cell_at[i + 1]].view(U)
                for nodes, parts, sizes, sketches in table:
                    width = min(len(own), sketches.shape[1])
                    # as unsigned numbers: bits of signed ones are counted in their absolute value
                    apart = np.bitwise_count(folded(sketches.view(U), width) ^ folded(own, width)).sum(axis=1, dtype=np.int64)
                    near = (parts != component) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                    near &= apart <= (100 - percent) * (sizes + n) // (100 + percent)
                    out += [(node, m, d, component, p) for m, d, p in zip(nodes[near].tolist(), apart[near].tolist(), parts[near].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names=["a", "b", "apart", "own", "other"])

    return rows.mapInArrow(run, "a long, b long, apart long, own long, other long")


def set_table(docs: DataFrame, classes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, n, sketch and set for the given nodes, from the text of the first document of each."""
    wanted = nodes.join(classes.select("node", F.col("doc_id").alias("w_doc"), F.col("text_hash").alias("w_hash"), F.col("other_hash").alias("w_other")), "node")
    same = F.col("w_doc").eqNullSafe(F.col("doc_id")) & (F.col("w_hash") == F.col("text_hash")) & (F.col("w_other") == F.col("other_hash"))
    rows = wanted.join(docs, same).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = [shingles(t, words) for t in b.column("text").to_pylist()]
            arrays = [b.column("node"), pa.array([len(y) for y in x], pa.int64()), pa.array([sketch(y) for y in x], pa.list_(pa.int64())), pa.array([y.tobytes() for y in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "sketch", "set"])

    return rows.mapInArrow(run, "node long, n long, sketch array<long>, set binary")


def by_token(rows: DataFrame, value: str = "node") -> DataFrame:
    """The rows whose token comes with several values, with the token's smallest node as leader and its number of rows.

    Counts and extremes are combined before the shuffle; frequent tokens then meet their rows by a broadcast.
    """
    by = rows.groupBy("token").agg(F.min("node").alias("leader"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).filter("low < high")
    by = written(by.drop("low", "high"), "tokens")
    total = by.agg(F.sum("n")).first()[0] or 0
    return hot_join(rows, by.withColumn("hot", F.col("n") * HOT_PART >= total), ["token"])


def groups_of(spread: DataFrame) -> DataFrame:
    """node, component and grp of every node: groups of GROUP_ROWS nodes on average. Those of one component come last."""
    homes = spread.groupBy("node", "component").agg(F.min("leader").alias("home"))  # the leader that a class meets first
    sizes = homes.groupBy("home", "component").agg(F.count("*").alias("n")).withColumn("fills", F.col("n") >= GROUP_ROWS)
    part = F.when(F.col("fills"), F.col("component")).otherwise(-1).alias("part")
    chunks = sizes.groupBy("home", part).agg(F.ceil(F.sum("n") / GROUP_ROWS).alias("chunks"))
    sizes = sizes.select("home", "component", "fills", part).join(chunks, ["home", "part"])
    chunk = F.pmod(F.xxhash64(F.when(F.col("fills"), F.col("node")).otherwise(F.col("component"))), F.col("chunks"))
    grp = F.shiftrightunsigned(F.xxhash64("home", "part", chunk), 2) + F.col("fills").cast("long") * (1 << 62)
    return homes.join(sizes, ["home", "component"]).select("node", "component", grp.alias("grp"))


def asked(spread: DataFrame, homes: DataFrame) -> DataFrame:
    """node, component and grp of the groups that hold one of a node's rarest tokens."""
    held = spread.select("node", "component", "tag", "need", "token", "n").join(homes.select("node", F.col("grp").alias("own_grp")), "node")
    matrix = spread.select("node", "token").join(homes, "node").groupBy("token", "grp").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    by = Window.partitionBy("node", "tag")  # a node's tokens: at most a few for each hundred shingles
    place = F.row_number().over(by.orderBy("n", "token"))
    rare = held.withColumn("place", place).withColumn("size", F.count("*").over(by)).filter("place <= size - need + 1")
    other = (F.col("grp") >= F.col("own_grp")) & ((F.col("low") != F.col("component")) | (F.col("high") != F.col("component")))
    return rare.join(matrix, "token").filter(other).select("node", "component", "grp").distinct()


def joined(parts: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after the components of parts have been joined by more, a table of (node, component) of them."""
    other = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = parts.join(other, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    alone = more.join(parts.select("node"), "node", "left_anti").select("node", "component")
    return written(moved.unionByName(alone), "parts")


def other_hash(text: str) -> Column:
    """A second hash of a text: texts are told apart by both, 128 bits, and their sizes."""
    return F.xxhash64(F.lit("other"), text)


def node_code(classes: DataFrame, bits: int = 62) -> Column:
    """A number for each class, from its hashes. Classes that would get the same number, a few among 2**31 and more
    texts, get another one from their hashes the other way round."""
    code = lambda *by: F.shiftrightunsigned(F.xxhash64(*by), 64 - bits)
    own, other = code("text_hash", "other_hash", "size"), code("other_hash", "text_hash", "size", F.lit("again"))
    twice = [r[0] for r in classes.groupBy(own.alias("c")).count().filter("count > 1").select("c").collect()]  # about n * n / 2 ** 63
    out = F.when(own.isin(twice), other).otherwise(own) if twice else own
    if twice and classes.groupBy(out.alias("c")).count().filter("count > 1").limit(1).count():
        raise ValueError("classes can't be told apart by their numbers")
    return out


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", counted: bool = True) -> DataFrame:
    """doc_id, text_hash, n_shingles and component of every row; component is null for texts without words.

    Two rows link when 100 * intersection >= percent * union of their sets of ``words``-word shingles, A-Z
    lower-cased; rows with equal texts always do. component is a number of the class that stands for it.

    Null texts are empty and link with nothing. Repeated rows and ids are rows of their own; ids may be null. The shingles
    of a very long text are an array in the task that reads it, and none is left out; an empty table gives no rows.
    Without ``counted`` n_shingles is only 0 or 1, for texts with words.
    """
    docs = narrowed(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64("text")).withColumn("other_hash", other_hash("text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(-1)))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]").cast("long")
    with tidied(docs.sparkSession) as kept:
        keys = written(counted_keys(docs, words) if counted else docs.select("doc_id", "text_hash", "other_hash", "size", worded.alias("n")), "keys")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
        same = ["text_hash", "other_hash", "size"]
        classes = keys.groupBy(*same).agg(F.count("*").alias("copies"), first).select(*same, "copies", F.col("first.doc_id").alias("doc_id"))
        hot = (F.col("copies") > 1) & (F.col("copies") * HOT_PART >= keys.count())
        classes = written(classes.withColumn("hot", hot), "classes")
        code = node_code(classes)
        classes = classes.withColumn("node", F.when(F.col("hot"), code).otherwise(code + (1 << 62)))
        hot = F.broadcast(classes.filter("hot").select(F.col("text_hash").alias("h_hash"), F.col("other_hash").alias("h_other"), F.col("size").alias("h_size"), F.col("doc_id").alias("h_doc")))  # at most HOT_PART rows
        is_hot = (F.col("text_hash") == F.col("h_hash")) & (F.col("other_hash") == F.col("h_other")) & F.col("size").eqNullSafe(F.col("h_size"))
        texts = docs.join(hot, is_hot, "left").filter(F.col("h_hash").isNull() | F.col("doc_id").eqNullSafe(F.col("h_doc")))
        texts = texts.select(F.when(F.col("h_hash").isNotNull(), code).otherwise(code + (1 << 62)).alias("node"), "text")
        every = written(token_sets(texts, words, percent), "token-sets").select("node", "tag", "need", F.explode("tokens").alias("token"))
        held = written(by_token(every).drop("leader", "n").distinct(), "shared")
        # a node whose shared tokens under a tag are fewer than a link needs has no link under that tag
        enough = held.groupBy("node", "tag", "need").agg(F.count("*").alias("n")).filter("n >= need").select("node", "tag")
        held = written(held.join(enough, ["node", "tag"]), "shared")
        held = written(by_token(held).drop("n"), "shared")
        sets = written(set_table(docs, classes, held.select("node").distinct(), words), "sets")
        facts = sets.select("node", "n", "sketch")
        near = held.filter("leader < node").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
        near = may_link(near, facts, percent).groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a"))
        near = written(near.select("a", "b"), "near")
        links = written(verified(near, sets.select("node", "set"), percent), "links")
        parts = components(links)

        held = written(held.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("leader"), "held")
        spread = written(by_token(held, "component"), "spread")
        homes = written(groups_of(spread), "homes")
        asks = spread.groupBy("node", "tag").agg(F.max("need").alias("need"), F.collect_list("token").alias("tokens"))  # a node's tokens
        facts = written(asks.groupBy("node").agg(F.collect_list(F.struct("need", "tokens")).alias("asks")).join(facts, "node"), "facts")
        more = opened(written(asked(spread, homes), "asked"), homes, facts, percent)
        more = written(more.join(near, (F.least(more.a, more.b) == near.a) & (F.greatest(more.a, more.b) == near.b), "left_anti"), "more")
        # of each node and each other component the nearest member first, then the rest where those did not link
        best = written(more.groupBy("a", "own", "other").agg(F.min_by("b", F.struct("apart", "b")).alias("b")).select("a", "b", "own", "other"), "best")
        found = verified(best.select("a", "b"), sets.select("node", "set"), percent).join(best, ["a", "b"])
        parts = joined(parts, components(found.select(F.col("own").alias("a"), F.col("other").alias("b"))))
        now = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"{k}_now"))
        open_pairs = more.select("own", "other").distinct().join(now("own"), "own", "left").join(now("other"), "other", "left")
        open_pairs = open_pairs.select("own", "other", F.coalesce("own_now", "own").alias("own_now"), F.coalesce("other_now", "other").alias("other_now")).filter("own_now <> other_now")
        rest = more.join(open_pairs, ["own", "other"]).join(best.select("a", "b"), ["a", "b"], "left_anti")
        rest = written(rest.select("a", "b", F.col("own_now").alias("own"), F.col("other_now").alias("other")), "rest")
        found = verified(rest.select("a", "b"), sets.select("node", "set"), percent).join(rest, ["a", "b"])
        parts = joined(parts, components(found.select(F.col("own").alias("a"), F.col("other").alias("b"))))
        final = parts.select(F.col("node").alias("l_node"), "component")

        nodes = classes.join(final, F.col("node") == F.col("l_node"), "left").select(*same, "hot", F.coalesce("component", "node").alias("component"))
        out = hot_join(keys, nodes, same)
        kept.append(written(out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).alias("component")), "components"))
        return kept[0]


def per_component(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """The rows that have a component, with an aggregate of it. rows: a written table."""
    hot = F.count("*") * HOT_PART >= rows.count()
    rows = rows.filter("component is not null")
    return hot_join(rows, written(rows.groupBy("component").agg(value.alias(name), hot.alias("hot")), name), ["component"])


def linked_documents(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach, itself included) of every row.

    See similarity_components for what links. A row without words is its own component.
    """
    rows = similarity_components(docs, words, percent, doc_id, text)
    linked = per_component(rows, F.min("doc_id"), "least").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return linked.unionByName(rows.filter("component is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of docs, with all columns: the smallest id, null ids last; rows without words all stay.

    Rows with the same id and text are one document: one of them stays. See similarity_components for what links. An
    empty table stays empty; the names of docs' columns are free.
    """
    rows = similarity_components(docs, words, percent, doc_id, text, counted=False)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    gone = per_component(rows, F.min(order), "k").filter(~(F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("text_hash") == F.col("k.text_hash"))))
    gone = gone.select("doc_id", "text_hash").distinct().alias("g")
    same = F.xxhash64(F.col(f"d.`{text}`")) == F.col("g.text_hash")
    left = docs.alias("d").join(gone, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("g.doc_id")) & same, "left_anti")
    repeated = rows.filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    if not repeated:
        return left
    worded = F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return left.filter(worded).dropDuplicates([doc_id, text]).unionByName(left.filter(~worded))
