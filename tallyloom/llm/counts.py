"""Edit-aware token counts: a segment tree of pre-token counts for each document.

A text is cut before each space that follows a non-space; a pre-token never crosses such a place and neither side
depends on the other, so segments are encoded apart. Leaves hold runs of segments, inner nodes the sums of
characters and tokens below. An edit re-encodes the segments that it touches and one to either side, whose
boundaries are then the same in the old and the new text, and updates the sums on the paths to the root.

leaf_table writes the leaves out, a row each; edited_leaves changes the few leaves that an edit touches in such a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import narrowed
from tallyloom.llm.packing import TextTokens, chunks, text_tokens

LEAF = 64
CACHE_SEGMENTS = 300_000


def segments(text: str) -> list[str]:
    """The text cut before each space that follows a non-space."""
    first, *rest = text.split(" ")
    out = [first]
    for x in rest:
        if out[-1] and not out[-1][-1].isspace():
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


class Counter:
    """Token counts of segments, kept for the commonest words."""

    def __init__(self, tokens: TextTokens) -> None:
        self.tokens = tokens
        self.known: dict[str, int] = {}

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_SEGMENTS:
            known.clear()
        new = list({p for p in parts if p not in known})
        known.update(zip(new, map(len, self.tokens.encode(new)), strict=True))
        return [known[p] for p in parts]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(text_tokens(path))


class TokenTree:
    """Leaves of segments under a complete binary tree of (characters, tokens)."""

    def __init__(self, parts: list[str], counts: list[int], counter: Counter) -> None:
        self.counter = counter
        self.leaves = [parts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.counts = [counts[i : i + LEAF] for i in range(0, len(parts), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k] = sum(map(len, leaf))
            self.tokens[self.width + k] = sum(self.counts[k])
        for node in range(self.width - 1, 0, -1):
            self.pull(node)
        self.encoded = 0

    def pull(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last leaf at the end), and the characters before the leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), before

    def edit(self, at: int, deleted: int, inserted: str) -> None:
        """Replaces ``deleted`` characters from ``at`` by ``inserted``; both are held to the text."""
        size = self.chars[1]
        at = max(0, min(at, size))
        end = min(size, at + max(0, deleted))
        first, before = self.find(max(0, at - 1))
        last, _ = self.find(end)
        # one segment to either side keeps its outer boundary; a leaf's first or last segment needs the leaf beside it
        first, last = max(0, first - 1), min(len(self.leaves) - 1, last + 1)
        before = self.before(first)
        parts = [p for leaf in self.leaves[first : last + 1] for p in leaf]
        low, place = 0, before
        while low < len(parts) and place + len(parts[low]) < at:
            place += len(parts[low])
            low += 1
        if low:
            low -= 1
            place -= len(parts[low])
        high, upto = low, place
        while high < len(parts) and upto <= end:
            upto += len(parts[high])
            high += 1
        if high < len(parts):
            upto += len(parts[high])
            high += 1
        region = "".join(parts[low:high])
        region = region[: at - place] + inserted + region[end - place :]
        new = segments(region)
        self.encoded += len(region)
        # the new segments go where the old ones were; their leaf may grow
        old = [c for leaf in self.counts[first : last + 1] for c in leaf]
        kept, counts = parts[:low] + new + parts[high:], old[:low] + self.counter.counts(new) + old[high:]
        share = -(-len(kept) // (last - first + 1)) if kept else 1
        for k in range(first, last + 1):
            own = slice((k - first) * share, (k - first + 1) * share)
            self.leaves[k], self.counts[k] = kept[own], counts[own]
            self.chars[self.width + k] = sum(map(len, self.leaves[k]))
            self.tokens[self.width + k] = sum(self.counts[k])
        nodes = {(self.width + k) >> 1 for k in range(first, last + 1)}
        while nodes - {0}:
            for node in nodes - {0}:
                self.pull(node)
            nodes = {n >> 1 for n in nodes if n > 1}

    def before(self, leaf: int) -> int:
        """Characters before a leaf: the sums of the left siblings on its path."""
        node, out = self.width + leaf, 0
        while node > 1:
            if node & 1:
                out += self.chars[node - 1]
            node >>= 1
        return out


def edited_counts(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited and n_chars_encoded of every row.

    ``edits`` is an array of (position, deleted, inserted), applied in turn; positions are code points of the text as
    it then is, and positions or lengths beyond it are held to it. Null texts are empty, null edits none, null
    inserted texts empty. n_chars_encoded tells how much the edits had encoded again. Repeated rows and null ids are
    rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"]
        for b in batches:
            texts, changes = [t or "" for t in b.column("text").to_pylist()], b.column("edits").to_pylist()
            out: dict[str, list[int]] = {k: [] for k in names}
            own = counter(tokenizer_path)
            for lo, hi in chunks(texts):
                cut = [segments(t) if t else [] for t in texts[lo:hi]]
                counts = own.counts([p for ps in cut for p in ps])
                at = 0
                for ps, edits_of in zip(cut, changes[lo:hi], strict=True):
                    tree = TokenTree(ps, counts[at : at + len(ps)], own)
                    at += len(ps)
                    out["n_tokens"].append(tree.tokens[1])
                    for e in edits_of or []:
                        tree.edit(e["position"] or 0, e["deleted"] or 0, e["inserted"] or "")
                    out["n_tokens_edited"].append(tree.tokens[1])
                    out["n_chars_edited"].append(tree.chars[1])
                    out["n_chars_encoded"].append(tree.encoded)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in names)], names=["doc_id", *names])

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(edits).cast("array<struct<position:bigint,deleted:bigint,inserted:string>>").alias("edits"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long")


def leaf_table(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, leaf (from 0), text, chars and tokens of every leaf: the text of a document is that of its leaves in order.

    Null and empty texts have one empty leaf, a very long text as many as it needs; an empty table has none. Leaves of
    rows with one id are not told apart: edited_leaves refuses to change them. Leaves of null ids are never changed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path)
        for b in batches:
            ids, texts = b.column("doc_id"), [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                row, leaf, pieces, tokens = [], [], [], []
                for i in range(lo, hi):
                    parts = segments(texts[i]) if texts[i] else []
                    tree = TokenTree(parts, own.counts(parts), own)
                    row += [i] * len(tree.leaves)
                    leaf += range(len(tree.leaves))
                    pieces += map("".join, tree.leaves)
                    tokens += map(sum, tree.counts)
                arrays = [ids.take(pa.array(row, pa.int64())), pa.array(leaf, pa.int32()), pa.array(pieces, pa.string()), pa.array([len(x) for x in pieces], pa.int64()), pa.array(tokens, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "leaf", "text", "chars", "tokens"])

    return narrowed(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, leaf int, text string, chars long, tokens long")


def edited_leaves(leaves: DataFrame, edits: DataFrame, tokenizer_path: str) -> DataFrame:
    """leaves after one edit (doc_id, position, deleted, inserted) of some documents.

    Only sizes are read of the leaves that an edit does not touch; those from the one before it to the one after it are
    put together, changed, cut into segments and counted again. Positions and lengths beyond a text are held to it, null
    ones are 0 and a null insertion is empty. A document may have one edit; further ones are made on the result. Edits of
    null and unknown ids change nothing; leaves that several rows of one id gave stop the query when an edit reaches them.
    """
    by = Window.partitionBy("doc_id").orderBy("leaf")
    sizes = leaves.select("doc_id", "leaf", "chars").join(edits.select("doc_id"), "doc_id", "left_semi")
    sizes = sizes.withColumn("before", F.sum("chars").over(by) - F.col("chars"))
    one = F.count("*") == F.max("leaf") + 1
    refused = F.raise_error(F.concat(F.lit("several rows have the id "), F.col("doc_id").cast("string"))).cast("long")
    total = sizes.groupBy("doc_id").agg(F.when(one, F.sum("chars")).otherwise(refused).alias("total"))
    at = F.least(F.greatest(F.coalesce("position", F.lit(0)), F.lit(0)), F.col("total"))
    own = edits.join(total, "doc_id").select("doc_id", at.cast("long").alias("at"), F.greatest(F.coalesce("deleted", F.lit(0)), F.lit(0)).alias("deleted"), F.coalesce("inserted", F.lit("")).alias("inserted"), "total")
    own = own.withColumn("end", F.least(F.col("total"), F.col("at") + F.col("deleted")).cast("long")).drop("deleted", "total")
    touched = sizes.join(own, "doc_id").filter((F.col("before") + F.col("chars") >= F.col("at") - 1) & (F.col("before") <= F.col("end")))
    span = touched.groupBy("doc_id").agg((F.min("leaf") - 1).alias("first"), (F.max("leaf") + 1).alias("last"))
    inside = sizes.join(span, "doc_id").filter("leaf between first and last").select("doc_id", "leaf", "before").join(own, "doc_id")
    rows = leaves.select("doc_id", "leaf", "text").join(inside, ["doc_id", "leaf"]).repartition("doc_id").sortWithinPartitions("doc_id", "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)

        def changed(doc: list[dict]) -> Iterator[tuple]:
            first = doc[0]
            if len({r["leaf"] for r in doc}) < len(doc):
                raise ValueError(f"several edits have the id {first['doc_id']!r}")
            text, a, b = "".join(r["text"] for r in doc), first["at"] - first["before"], first["end"] - first["before"]
            parts = segments(text[:a] + first["inserted"] + text[b:])
            n, share = count.counts(parts), -(-len(parts) // len(doc)) if parts else 1
            for k, r in enumerate(doc):
                own = slice(k * share, (k + 1) * share)
                piece = "".join(parts[own])
                yield r["doc_id"], r["leaf"], piece, len(piece), sum(n[own])

        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and held[0]["doc_id"] != r["doc_id"]:
                    out += changed(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], b.schema.field("doc_id").type if not k else kind) for k, kind in enumerate(kinds)], names=names)
        if held:
            out = list(changed(held))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], b.schema.field("doc_id").type if not k else kind) for k, kind in enumerate(kinds)], names=names)

    names, kinds = ["doc_id", "leaf", "text", "chars", "tokens"], [None, pa.int32(), pa.string(), pa.int64(), pa.int64()]
    new = rows.mapInArrow(run, f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf int, text string, chars long, tokens long")
    return leaves.select(*names).join(inside.select("doc_id", "leaf"), ["doc_id", "leaf"], "left_anti").unionByName(new)


def sample_edits(text: str = "text"):
    """Three edits made from the text itself: a deletion, an insertion and a replacement at the end."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    edit = lambda at, gone, new: F.struct(at.cast("long").alias("position"), F.lit(gone).cast("long").alias("deleted"), new.alias("inserted"))
    return F.array(edit(F.floor(n / 3), 37, F.lit("")), edit(F.floor(n / 4), 0, F.substring(t, 5, 29)), edit(n - 20, 9, F.substring(t, 2, 13)))
