"""Packing by concatenate and cut.

Documents are tokenised once into a table that keeps, for each, the tokens before it in its partition. Partition
totals are summed to offsets (the second pass), so every document has a place in one stream of tokens without a
sort or a shuffle of texts. The stream is cut every ``window`` tokens; a document that crosses a cut gives a
boundary record on either side.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import exclusive_sum, narrowed, small, written

#: Texts with other characters are left to the tokenizer, so that no class of characters is judged by two regex engines.
PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, by its public rule: printable ones are themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TextTokens:
    """Token ids of whole texts by a tokenizer file.

    Byte-level BPE files whose ids follow their merges are also read as ranks: plain texts are then encoded several
    times faster, with the same ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self.ranked(json.loads(self.tokenizer.to_str()))

    def ranked(self, spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        pre, vocab, merges = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab", {}), spec["model"].get("merges", [])
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("type") != "BPE":
            return None
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made != sorted(made):
            return None
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def plain(self, text: str) -> bool:
        return self.fast is not None and not PLAIN.search(text) and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self.fast(t) if self.plain(t) else None for t in texts]
        if rest := [i for i, x in enumerate(out) if x is None]:
            for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out


@lru_cache(maxsize=2)
def text_tokens(path: str) -> TextTokens:
    return TextTokens(path)


def chunks(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, part, start_in_part, n, ids): ids are packed in 2 bytes each if the vocabulary allows it."""
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) > 1 << 16
    dtype = "<u4" if wide else "<u2"
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_tokens(tokenizer_path)
        part, at, width = TaskContext.get().partitionId(), 0, np.dtype(dtype).itemsize
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                ids = [np.array([*x, end_id], dtype).tobytes() for x in enc.encode(texts[lo:hi])]
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "start_in_part", "n", "ids"],
                )

    return docs.mapInArrow(run, f"doc_id {id_type}, part int, start_in_part long, n long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    Returns a row per piece: doc_id, start and length in the document's tokens, doc_tokens, sequence_id, offset in
    the sequence, and ids (little-endian unsigned 32-bit). Every token lies in one piece and every sequence but the
    last is full.

    A null text counts as empty and gives the end token alone. Repeated rows, repeated and null ids are packed as
    rows of their own; no rows give no pieces. A very long text is encoded whole, alone, and cut into as many pieces as it
    needs. Columns other than the two named are ignored.
    """
    table = written(token_table(narrowed(docs, doc_id=doc_id, text=text), tokenizer_path, end_id), "tokens")
    totals = written(table.groupBy("part").agg(F.sum("n").alias("total")), "totals")
    offsets = totals.select("part", exclusive_sum("total", ["part"]).alias("before"))  # a row per task of the first pass
    placed = table.join(small(offsets, totals.count()), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = b.column("at").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
            first, last = at // window, (at + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            lo = np.maximum(at[row], sequence * window)
            hi = np.minimum(at[row] + n[row], (sequence + 1) * window)
            start, length = lo - at[row], hi - lo
            packed = b.column("ids").to_pylist()
            width = [len(x) // k for x, k in zip(packed, n.tolist(), strict=True)]
            cut = [np.frombuffer(packed[r], f"<u{width[r]}", k, s * width[r]).astype("<u4").tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), *(pa.array(x) for x in (start, length, n[row], sequence, lo - sequence * window)), pa.array(cut, pa.binary())],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    id_type = docs.schema[doc_id].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
