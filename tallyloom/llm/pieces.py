"""SentencePiece encoding and decoding in batches of equal-length words, with numpy.

A text is cut into words before each run of word marks. Words of one length form a matrix and advance together,
position by position: prefix hashes give the hash of every substring that ends there, a sorted table of the pieces'
hashes gives its id, and the best start by row-wise maxima is the back pointer.

* A unigram file's pieces have scores, and the best sum of scores is the encoding.
* A BPE file's scores are ranks of merges, and their best sum is not the encoding. But a row of pieces is the encoding
  exactly if merging would leave each two neighbours as they are, so of all pieces that end at a position only one fits
  the last piece before its start: it gains 0, the others minus infinity. Whether two pieces stay apart is told by
  undoing their merges, the latest first, and looking for an earlier merge across their border.

Characters without a piece become bytes if the file has them, else the unknown id. A file for which the second
statement does not hold (a piece that merging its own characters doesn't give) is merged pair by pair instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from tallyloom.llm.common import narrowed

MARK = "▁"
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
#: Fixed values of the file format: kinds of pieces, kinds of models, and what an unknown character costs.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_COST = 10.0
#: Bytes of words and ids that a worker keeps, about; longer words than LONG characters are never kept.
CACHE_BYTES = 160 << 20
LONG = 64
#: Pairs of pieces of which a worker remembers whether they stay apart: in a dictionary, and in places by hash (a power of two).
CACHE_PAIRS, PLACES = 300_000, 1 << 18
#: Cells of the matrices that advance together, and the fewest words for which matrices pay.
BLOCK_CELLS = 2_000_000
FEWEST = 48
#: Later than any merge.
NEVER = 1 << 40


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class PieceModel:
    """A SentencePiece file without character maps."""

    def __init__(self, path: str) -> None:
        self.kind, self.prefix, self.squeeze = UNIGRAM, True, True
        self.words: list[str] = []
        scores, kinds = [], []
        with open(path, "rb") as file:
            raw = file.read()
        for field, value in fields(raw):
            if field == 1:
                piece = dict(fields(value))
                self.words.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(fields(value))
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2) or not spec.get(5, 1):
                    raise ValueError("files with a character map or bare spaces are not supported")
        if self.kind not in (UNIGRAM, BPE) or USER in kinds:
            raise ValueError("only unigram and BPE files without user-defined pieces are supported")
        self.bytes = {int(w[3:5], 16): i for i, (w, k) in enumerate(zip(self.words, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, UNUSED)]
        self.id_of = {self.words[i]: i for i in usable}
        self.longest = max(len(self.words[i]) for i in usable)
        keys = np.array([self.hash_of(self.words[i]) for i in usable], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.seen = np.zeros(1 << 20, bool)  # leading bits of the keys: most substrings are no piece
        self.seen[(keys >> U(44)).astype(np.int64)] = True
        self.score = np.array(scores)
        self.sizes = np.array([len(w) for w in self.words])
        self.least = min(scores[i] for i in usable) - UNKNOWN_COST
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.cuts_words = not any(inner.search(self.words[i]) for i in usable)
        self.cuts_lines = not any("\n" in self.words[i] for i in usable)
        self.inside = {w[k : k + 2] for w in self.id_of for k in range(len(w) - 1)}
        raw = [bytes([int(w[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else w.replace(MARK, " ").encode() if k != UNKNOWN else b" \xe2\x81\x87 " for w, k in zip(self.words, kinds, strict=True)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self.apart: dict[int, bool] = {}
        self.by_pairs = self.kind == BPE and self.undone(usable)

    def undone(self, usable: list[int]) -> bool:
        """Notes when each piece is made and of which two, by merging its own characters; False if some piece isn't made."""
        multi = [i for i in usable if len(self.words[i]) > 1]
        n = len(self.words)
        ranks = np.unique(-self.score[multi], return_inverse=True)[1] + 1
        self.born = np.zeros(n + 1, np.int64)  # the last entry is a character without a piece
        self.born[multi] = ranks
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        by_size: dict[int, list[int]] = {}
        for i in multi:
            by_size.setdefault(len(self.words[i]), []).append(i)
        for size, own in by_size.items():
            prefix, power = self.prefixes([self.words[i] for i in own])
            _, count, cut = self.merge(prefix, power)
            first = [self.id_of.get(self.words[i][:c], -1) for i, c in zip(own, cut.tolist(), strict=True)]
            rest = [self.id_of.get(self.words[i][c:], -1) for i, c in zip(own, cut.tolist(), strict=True)]
            if (count > 1).any() or -1 in first or -1 in rest:
                return False
            self.left[own], self.right[own] = first, rest
        keys = self.left[multi] * (n + 1) + self.right[multi]
        order = np.argsort(keys)
        self.pair_keys, self.pair_born = keys[order], self.born[multi][order]
        self.merge_of = dict(zip(keys.tolist(), self.born[multi].tolist(), strict=True))
        self.trees = list(zip(self.born.tolist(), self.left.tolist(), self.right.tolist(), strict=True))
        self.place_key, self.place_ok = np.full(PLACES, -1, np.int64), np.zeros(PLACES, bool)
        return True

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the neighbours a and b (ids) as they are; the last pair of each place is remembered."""
        key = a * len(self.born) + b
        place = (key * 0x9E3779B1 >> 15) & (PLACES - 1)
        ok = self.place_ok[place]
        new = np.flatnonzero(self.place_key[place] != key)
        if len(new):
            ok[new] = self.tested(a[new], b[new])
            self.place_key[place[new]], self.place_ok[place[new]] = key[new], ok[new]
        return ok

    def tested(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same, by undoing merges."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        until = np.full(len(a), NEVER)
        while len(at):
            key = a * len(self.born) + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[k] == key) & (self.pair_born[k] < until)
            ok[at[crossed]] = False
            x, y = self.born[a], self.born[b]
            go = ~crossed & ((x > 0) | (y > 0))
            a, b, x, y, at = a[go], b[go], x[go], y[go], at[go]
            # of equal merges the left one is made first
            late = x > y
            until = np.where(late, x, y + 1)
            a, b = np.where(late, self.right[a], a), np.where(late, b, self.left[b])
        return ok

    def stays(self, a: int, b: int) -> bool:
        """The same for one pair, remembered."""
        key = a * len(self.trees) + b
        known = self.apart.get(key)
        if known is not None:
            return known
        if len(self.apart) > CACHE_PAIRS:
            self.apart.clear()
        trees, merge_of, width, until, ok = self.trees, self.merge_of, len(self.trees), NEVER, True
        while True:
            if merge_of.get(a * width + b, NEVER) < until:
                ok = False
                break
            x, y = trees[a][0], trees[b][0]
            if not x and not y:
                break
            if x > y:
                until, a = x, trees[a][2]
            else:
                until, b = y + 1, trees[b][1]
        self.apart[key] = ok
        return ok

    @staticmethod
    def hash_of(word: str) -> U:
        h = U(0)
        with np.errstate(over="ignore"):
            for c in word:
                h = h * BASE + U(ord(c) + 1)
        return h

    def find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes and sizes, -1 where there is none."""
        out = np.full(h.shape, -1, np.int64)
        maybe = np.nonzero(self.seen[(h >> U(44)).astype(np.int64)])
        own = h[maybe]
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        got = self.ids[at]
        out[maybe] = np.where((self.keys[at] == own) & (self.sizes[got] == np.broadcast_to(size, h.shape)[maybe]), got, -1)
        return out

    def split(self, text: str) -> list[str]:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return []
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if not self.cuts_words:
            return [text]
        out: list[str] = []
        for line in text.split("\n") if self.cuts_lines else [text]:
            if out and self.cuts_lines:
                out.append("\n")
            first, *rest = line.split(MARK)
            if first:
                out.append(first)
            if "" not in rest:
                out += [MARK + x for x in rest]
                continue
            marks = ""
            for x in rest:
                marks += MARK
                if x:
                    out.append(marks + x)
                    marks = ""
            if marks:
                out.append(marks)
        return out

    def prefixes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the prefixes of words of one length, and the powers of the base."""
        n, size = len(words), len(words[0])
        codes = np.array(words).view(np.uint32).reshape(n, -1)[:, :size].astype(U) + U(1)
        prefix, power = np.zeros((n, size + 1), U), np.ones(size + 1, U)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * BASE + codes[:, j]
            power[j + 1 :] *= BASE
        return prefix, power

    def packed(self, words: list[str]) -> list[bytes]:
        """Ids of words that have one length."""
        if self.by_pairs and len(words) < FEWEST:
            return [self.walk(w) for w in words]
        size = len(words[0])
        prefix, power = self.prefixes(words)
        if self.kind == BPE and not self.by_pairs:
            bounds, count, _ = self.merge(prefix, power)
        else:
            bounds, count = self.viterbi(prefix, power)
        low, high = bounds[:, :-1], bounds[:, 1:]
        h = np.take_along_axis(prefix, high, 1) - np.take_along_axis(prefix, low, 1) * power[np.maximum(high - low, 0)]
        inside = np.arange(size) < count[:, None]
        ids = self.find(h, np.where(inside, high - low, -1)).astype("<i4")
        odd = (inside & (ids < 0)).any(axis=1)
        out = [x[:k].tobytes() for x, k in zip(ids, count.tolist(), strict=True)]
        for r in np.flatnonzero(odd).tolist():
            pairs = zip(ids[r, : count[r]].tolist(), bounds[r, : count[r]].tolist(), strict=True)
            out[r] = self.with_bytes([(i, words[r][at]) for i, at in pairs])
        return out

    def with_bytes(self, row: list[tuple[int, str]]) -> bytes:
        """Packed ids of a row of (id, first character), where a negative id is a character without a piece."""
        flat: list[int] = []
        for i, c in row:
            flat += [i] if i >= 0 else [self.bytes[x] for x in c.encode()] if self.bytes else [self.unknown]
        return np.array(flat, "<i4").tobytes()

    def walk(self, word: str) -> bytes:
        """Ids of one word of a BPE file: the same back pointers without matrices."""
        get, stays, odd = self.id_of.get, self.stays, len(self.words)
        last, back = [odd] * (len(word) + 1), [0] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - self.longest), end):
                i = get(word[start:end], odd)
                if i == odd and start < end - 1:
                    continue
                if not start or stays(last[start], i):
                    last[end], back[end] = i, start
                    break
        row, at = [], len(word)
        while at:
            row.append((last[at] if last[at] != odd else -1, word[back[at]]))
            at = back[at]
        return self.with_bytes(row[::-1])

    def viterbi(self, prefix: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the pieces of every row, from the left, and the number of pieces."""
        n, size = prefix.shape[0], prefix.shape[1] - 1
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        last = np.full((n, size + 1), len(self.words), np.int64)
        rows = np.arange(n)
        for end in range(1, size + 1):
            starts = np.arange(max(0, end - self.longest), end)
            h = prefix[:, end, None] - prefix[:, starts] * power[end - starts]
            ids = self.find(h, end - starts)
            if self.by_pairs:
                ids[:, -1] = np.where(ids[:, -1] < 0, len(self.words), ids[:, -1])
                r, c = np.nonzero(ids >= 0)
                fits = starts[c] == 0
                ask = np.flatnonzero(~fits)
                fits[ask] = self.stay(last[r[ask], starts[c[ask]]], ids[r[ask], c[ask]])
                gain = np.full(ids.shape, -np.inf)
                gain[r[fits], c[fits]] = 0
            else:
                gain = np.where(ids >= 0, self.score[ids], np.where(starts == end - 1, self.least, -np.inf))
            total = best[:, starts] + gain
            k = total.argmax(axis=1)
            best[:, end], back[:, end], last[:, end] = total[rows, k], starts[k], ids[rows, k]
        on = np.zeros((n, size + 1), bool)
        at = np.full(n, size)
        on[:, [0, size]] = True
        while len(rows):
            at = back[rows, at]
            on[rows, at] = True
            rows, at = rows[at > 0], at[at > 0]
        order = np.argsort(~on, axis=1, kind="stable")
        count = on.sum(axis=1) - 1
        return np.where(np.arange(size + 1) <= count[:, None], order, size), count

    def merge(self, prefix: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by merging the best adjacent pair, the leftmost among equals, again and again; also the last cut that went."""
        n, size = prefix.shape[0], prefix.shape[1] - 1
        bounds = np.tile(np.arange(size + 1), (n, 1))
        count, gone = np.full(n, size), np.zeros(n, np.int64)
        live = np.arange(n) if size > 1 else np.zeros(0, np.int64)
        while len(live):
            width = int(count[live].max())
            b = bounds[live, : width + 1]
            p = prefix[live]
            low, high = b[:, :-2], b[:, 2:]
            h = np.take_along_axis(p, high, 1) - np.take_along_axis(p, low, 1) * power[np.maximum(high - low, 0)]
            ids = self.find(h, high - low)
            ids = np.where(np.arange(width - 1) < count[live, None] - 1, ids, -1)
            score = np.where(ids >= 0, self.score[ids], -np.inf)
            k = score.argmax(axis=1)
            joins = score[np.arange(len(live)), k] > -np.inf
            live, k, b = live[joins], k[joins], b[joins]
            if not len(live):
                break
            gone[live] = b[np.arange(len(live)), k + 1]
            after = np.concatenate([b[:, 1:], b[:, -1:]], axis=1)
            bounds[live, : width + 1] = np.where(np.arange(width + 1) > k[:, None], after, b)
            count[live] -= 1
            live = live[count[live] > 1]
        return bounds, count, gone

    def shortened(self, words: list[str]) -> list[str]:
        """words, with long ones cut between characters that no piece has side by side: neither half depends on the other."""
        if max(map(len, words), default=0) <= LONG:
            return words
        out: list[str] = []
        for w in words:
            start = 0
            if len(w) > LONG:
                for k in range(1, len(w)):
                    if w[k - 1 : k + 1] not in self.inside:
                        out.append(w[start:k])
                        start = k
            out.append(w[start:])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cache = self.cache
        cut = [self.shortened(self.split(t)) for t in texts]
        by_size: dict[int, list[str]] = {}
        for w in {w for ws in cut for w in ws if w not in cache}:
            by_size.setdefault(len(w), []).append(w)
        long: list[str] = []
        for size, words in by_size.items():
            step = max(1, BLOCK_CELLS // (size * self.longest))
            for i in range(0, len(words), step):
                cache.update(zip(words[i : i + step], self.packed(words[i : i + step]), strict=True))
            self.held += len(words) * (200 + 8 * size)
            if size > LONG:
                long += words
        get = cache.__getitem__
        out = [b"".join(map(get, ws)) for ws in cut]
        for w in long:
            self.held -= 200 + 8 * len(w)
            del cache[w]
        if self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        out = []
        for x in packed:
            ids = np.frombuffer(x, "<i4")
            parts = []
            for k in range(0, len(ids), 1 << 18):
                own = ids[k : k + (1 << 18)]
                size = self.raw_size[own]
                at = np.repeat(self.raw_at[own] - (np.cumsum(size) - size), size)
                parts.append(self.raw[at + np.arange(len(at))].tobytes())
            text = b"".join(parts).decode(errors="replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def runs(texts: list[str], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian 32-bit numbers) of every row.

    Null and empty texts have no ids. Repeated rows and null ids are rows of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for lo, hi in runs(texts):
                ids = model(model_path).encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return narrowed(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {id_type}, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """The columns of encoded and decoded, the text that the ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model(model_path).decode([x or b"" for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and round_trip (whether decoding gives the text again) of every row.

    Each block of texts is encoded and decoded in one step, so neither texts nor ids leave the worker. Nulls, empty
    texts and repeats as in encode; a null text makes the trip as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, own = [t or "" for t in b.column("text").to_pylist()], model(model_path)
            n, crc, same = [], [], []
            for lo, hi in runs(texts):
                ids = own.encode(texts[lo:hi])
                n += [len(x) // 4 for x in ids]
                crc += map(zlib.crc32, ids)
                same += [x == t for x, t in zip(own.decode(ids), texts[lo:hi], strict=True)]
            arrays = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    return narrowed(docs, doc_id=doc_id, text=text).mapInArrow(run, f"doc_id {id_type}, n_ids long, ids_crc32 long, round_trip boolean")
