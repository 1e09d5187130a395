"""Quality rules on repetition inside a document, by suffix arrays over words.

Words become numbers. Only words inside some repeated run of ``min_words`` can lie in a long repeat, so the rest of
the text is cut out before sorting; the parts that stay, of many documents at once, form one array with a number of
its own at each cut. Adjacent suffixes' longest common prefixes give the maximal repeats: the union of their spans
is the covered part of a document, the largest prefix its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import SPACES, narrowed

SYMBOLS = b"#*$%&|<>"
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words that are sorted together, unless one document has more.
BLOCK = 150_000


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of x, and the common prefix of each with the one before it (0 for the first)."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:] if step < n else []
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        if rank[order[-1]] == n - 1:
            break
        levels.append(rank)
        step *= 2
    common = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside.copy()
        same[inside] = levels[k][i[inside]] == levels[k][j[inside]]
        step = same * (1 << k)
        common[1:] += step
        i += step
        j += step
    return order, common


def repeats(words: list[np.ndarray], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document (its words as numbers from 0): words covered by repeats of min_words or more, and the longest."""
    covered, longest = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    parts, where, owner, at, base = [], [], [], [], 0
    for d, x in enumerate(words):
        n = len(x) - min_words + 1
        if n < 2 or x.max(initial=0) + 1 == len(x):
            continue
        h = np.zeros(n, np.uint64)
        for k in range(min_words):
            h = (h ^ (h >> np.uint64(29))) * ODD + x[k : k + n].astype(np.uint64)
        values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        if len(values) == n:
            continue
        active = np.zeros(len(x) + 1, bool)
        hit = np.flatnonzero(counts[inverse] > 1)
        for k in range(min_words):
            active[hit + k] = True
        keep = np.flatnonzero(active)
        cut = np.flatnonzero(np.diff(keep) > 1)
        piece = np.insert(x[keep] + 1, cut + 1, 0)  # 0: a cut, numbered below
        parts += [np.where(piece > 0, piece + base, 0), [0]]
        where += [np.insert(keep, cut + 1, -1), [-1]]
        owner += [d] * (len(piece) + 1)
        base += int(x.max()) + 2
    if not parts:
        return covered, longest
    x, where, owner = np.concatenate(parts).astype(np.int64), np.concatenate(where), np.array(owner)
    cuts = np.flatnonzero(x == 0)
    x[cuts] = base + 1 + np.arange(len(cuts))
    order, common = suffix_array(x)
    best = np.maximum(common, np.append(common[1:], 0))  # the longest repeat that starts at each suffix
    long = best >= min_words
    starts, lengths = order[long], best[long]
    np.maximum.at(longest, owner[starts], lengths)
    edge = np.zeros(len(x) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    inside = np.cumsum(edge[:-1]) > 0
    np.add.at(covered, owner[inside], 1)
    return covered, longest


def measure(texts: list[str | None], min_words: int) -> dict[str, np.ndarray]:
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")}
    waiting: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def flush() -> None:
        covered, longest = repeats(waiting, min_words)
        out["n_repeat_words"][rows], out["longest_repeat"][rows] = covered, longest
        waiting.clear()
        rows.clear()

    spaces = SPACES.encode()
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        words = raw.split()
        if not words:
            out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
            continue
        numbers: dict[bytes, int] = {}
        x = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(t) - (len(raw) - len(raw.translate(None, spaces)))
        out["n_symbols"][i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [s for s in raw.split(b"\n") if s.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if len(numbers) < len(words):
            waiting.append(x)
            rows.append(i)
            size += len(words)
            if size > BLOCK:
                flush()
                size = 0
    if waiting:
        flush()
    return out


def repetition_rules(
    docs: DataFrame,
    min_words: int = 5,
    fewest_words: int = 10,
    most_covered: float = 0.2,
    most_longest: int = 100,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Counts and the verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    longest_repeat (words), base_failed and kept.

    base_failed: fewer than ``fewest_words`` words, or more than ``most_covered`` of them in repeats of ``min_words``
    or more. kept: not base_failed, and no repeat longer than ``most_longest`` words.

    Null and empty texts have zero everywhere and are not kept. Every row gets its own result, repeated rows and
    null ids too; an empty table gives an empty one. A very long text is sorted alone, in memory in proportion to
    its repeated words. Other columns are ignored.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(b.column("text").to_pylist(), min_words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[k]) for k in names)], names=["doc_id", *names])

    id_type = docs.schema[doc_id].dataType.simpleString()
    found = narrowed(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{k} long" for k in names))
    share = Fraction(str(most_covered))
    failed = (F.col("n_words") < fewest_words) | (share.denominator * F.col("n_repeat_words") > share.numerator * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("longest_repeat") <= most_longest))


def kept_documents(docs: DataFrame, min_words: int = 5, fewest_words: int = 10, most_covered: float = 0.2, most_longest: int = 100, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that repetition_rules would keep; see there.

    Rows with null and empty texts go. Rows with equal texts stay or go alike, repeated rows and null ids too. A very long
    text is judged whole, alone in memory; an empty table stays empty. The names of docs' columns are free.
    """
    at, share = docs.columns.index(text), Fraction(str(most_covered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(b.column(at).to_pylist(), min_words)
            n, covered = got["n_words"], got["n_repeat_words"]
            keep = (n >= fewest_words) & (share.denominator * covered <= share.numerator * n) & (got["longest_repeat"] <= most_longest)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
