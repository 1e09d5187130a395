"""Language-model scores by deleted interpolation.

The probability of a token is a chain of mixtures: in a context of k - 1 tokens, lambda times the maximum-likelihood
estimate of the k-gram and the rest times the probability in the context without its first token, down to a uniform
share over the vocabulary and one unknown token. lambda depends on k and on the bucket of the context's frequency (the
number of its binary digits). A part of the training texts is deleted from the counts, and expectation-maximisation
over its tokens, as counts of a chunk's equal situations, learns the lambdas. Final estimates count all training texts.

Counting is a question to and an answer from tasks that hold ranges of hashes. Texts are cut into chunks of tokens once,
in a table bucketed by chunk. Each chunk sends its distinct n-grams with their counts, as packed arrays; the task that
holds a range adds them up and answers each chunk in the order in which it asked. The answers, bucketed by chunk too,
meet the chunks without a shuffle. No n-gram is sent more than once by a chunk, however frequent it is, so no task gets
more than one row of a frequent word from each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bucketed, narrowed, tidied, written

#: Tokens of a chunk, and n-grams that a task which adds counts holds at once, about. Both bound memory. A chunk sends a
#: row for each range: on corpora where that leaves few n-grams a row, raise both with the memory of the executors.
CHUNK, RANGE = 1 << 20, 1 << 20

#: What marks the start of a text (never a token, only a context) and its end: no word contains them.
START, END = b"\t", b"\n"

#: Parts of the documents.
HELD_OUT, DELETED, FIT = 0, 1, 2

PLACES = 64

#: A word's 96-bit hash: a key, which names its range, and more bits.
WORD = np.dtype([("key", ">u8"), ("more", ">u4")])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(raw) // max(1, n)] = np.frombuffer(raw, np.uint8).reshape(-1, n).T if n else 0
    return out.view("<u8").ravel()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(doc_id: str) -> Column:
    """Held out: crc32 of the id's text is a multiple of 10; deleted from the counts: a tenth of the others."""
    code = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.when(code % 10 == 0, HELD_OUT).when(F.floor(code / 10) % 10 == 0, DELETED).otherwise(FIT)


class Chunk:
    """Texts on their way into a chunk: token ids number the chunk's words in the order in which they came."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.end = [self.words[w] for w in (START, END)][1]
        self.docs, self.parts, self.lengths, self.tokens, self.n = [], [], [], [], 0

    def add(self, doc_id: int | None, part: int, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, space and tab to carriage return
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        self.docs.append(doc_id)
        self.parts.append(part)
        self.lengths.append(len(ids) + 1)
        self.tokens += [ids, np.array([self.end], np.uint32)]
        self.n += len(ids) + 1

    def row(self, chunk: int) -> pa.RecordBatch:
        import xxhash

        words = b"".join(xxhash.xxh3_128_digest(w)[: WORD.itemsize] for w in self.words)
        cells = [chunk, self.n, self.docs, bytes(self.parts), np.array(self.lengths, "<u4").tobytes(), packed(np.concatenate(self.tokens)), words]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, CHUNKS, strict=True)], schema=CHUNKS)


CHUNKS = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("parts", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())])
CHUNKS_SQL = "chunk long, n long, docs array<long>, parts binary, lengths binary, tokens binary, words binary"


def chunking(size: int):
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of at least so many tokens (but for a task's last), numbered by task and place."""
        at, open_ = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            for doc in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "part", "text")], strict=True):
                open_.add(*doc)
                if open_.n >= size:
                    yield open_.row(at)
                    at, open_ = at + 1, Chunk()
        if open_.n:
            yield open_.row(at)

    return chunked


class Grams:
    """A chunk's distinct n-grams of each order, in the order in which they are asked about."""

    def __init__(self, row: dict, order: int, ranges: int) -> None:
        self.docs, parts, lengths = row["docs"], np.frombuffer(row["parts"], np.uint8), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        tokens, words = unpacked(row["tokens"], int(lengths.sum())).astype(np.int64), np.frombuffer(row["words"], WORD)
        self.starts = np.cumsum(lengths) - lengths
        self.lengths, self.doc_parts, self.parts = lengths, parts, np.repeat(parts, lengths)
        self.more, self.ranges = words["more"].astype(np.uint32), ranges
        low = words["key"].astype(np.uint64)
        #: Of each order: places of its grams' counts by token, keys, and where each range begins in the order of questions.
        self.place, self.keys, self.perm, self.cuts = [], [], [], []
        hashes, start, index, at_start = low, low[:1], tokens, 0
        for k in range(1, order + 1):
            if k > 1:
                # the context of a token is the gram before it; at a text's start, the one of start marks alone
                before = np.concatenate([[0], index[:-1]])
                before[self.starts] = at_start
                grams, index = np.unique(before * len(words) + tokens, return_inverse=True)
                contexts = np.append(hashes, start)
                hashes = mixed(mixed(contexts[grams // len(words)]) + low[grams % len(words)])
                start, at_start = mixed(mixed(start) + low[:1]), len(grams)
            keys = hashes[1:] if k == 1 else hashes  # of words, all but the start
            perm = np.lexsort((self.more[1:], keys)) if k == 1 else np.argsort(keys)
            self.place.append(index - 1 if k == 1 else index)
            self.keys.append(keys)
            self.perm.append(perm)
            self.cuts.append(np.searchsorted(self.range_of(keys[perm]), np.arange(ranges + 1)))
            if k == 1:
                at_start = 0  # the start's own place among the words

    def range_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)

    def questions(self) -> Iterator[tuple]:
        """(range, order, n, keys, more bits of words, counts of the fitted, of the deleted) for each range."""
        for k, (place, keys, perm, cuts) in enumerate(zip(self.place, self.keys, self.perm, self.cuts, strict=True), 1):
            fit, deleted = (np.bincount(place[self.parts == p], minlength=len(keys))[perm].astype(np.uint64) for p in (FIT, DELETED))
            keys, more = keys[perm], self.more[1:][perm] if k == 1 else None
            for r in range(self.ranges):
                s = slice(cuts[r], cuts[r + 1])
                if cuts[r] < cuts[r + 1]:
                    steps = np.diff(keys[s], prepend=np.uint64(lowest(r, self.ranges)))
                    yield r, k, int(cuts[r + 1] - cuts[r]), packed(steps), more[s].tobytes() if k == 1 else b"", packed(fit[s]), packed(deleted[s])

    def answered(self, answers: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Counts of each token's gram of each order in the fitted texts and in all training texts."""
        deleted, every = ([np.zeros(len(k), np.int64) for k in self.keys] for _ in range(2))
        for a in answers:
            k = a["order"] - 1
            at = self.perm[k][self.cuts[k][a["range"]] : self.cuts[k][a["range"] + 1]]
            deleted[k][at], every[k][at] = unpacked(a["deleted"], len(at)), unpacked(a["every"], len(at))
        return [(e - d)[p] for e, d, p in zip(every, deleted, self.place, strict=True)], [e[p] for e, p in zip(every, self.place, strict=True)]

    def of_contexts(self, counts: list[np.ndarray], tokens: int, docs: int) -> list[np.ndarray]:
        """Frequency of each token's context of each order: all tokens, then the counts of the gram before it."""
        out = [np.full(len(self.parts), tokens, np.int64)]
        for c in counts[:-1]:
            before = np.concatenate([[0], c[:-1]])
            before[self.starts] = docs  # a context of start marks is met once a text
            out.append(before)
        return out


def lowest(r: int, ranges: int) -> int:
    """The smallest key of a range."""
    return -((-r << 32) // ranges) << 32


QUESTIONS = "range int, order int, chunk long, n int, keys binary, more binary, fit binary, deleted binary"
ANSWERS = "chunk long, range int, order int, deleted binary, every binary, fit_words long, every_words long"


def asking(order: int, ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), ("order", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("keys", "more", "fit", "deleted")]])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                cells = [[r, k, row["chunk"], *rest] for r, k, *rest in Grams(row, order, ranges).questions()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), schema, strict=True)], schema=schema)

    return ask


def adding(ranges: int):
    def add(key: tuple, table: pa.Table) -> pa.Table:
        """The sums of one range and order, told to each chunk that asked."""
        rows = table.to_pylist()
        ns = [r["n"] for r in rows]
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["n"])) + np.uint64(lowest(r["range"], ranges)) for r in rows])
        if rows[0]["order"] == 1:
            more = np.concatenate([np.frombuffer(r["more"], np.uint32) for r in rows])
            by = np.lexsort((more, keys))
            new = np.concatenate([[True], (np.diff(keys[by]) != 0) | (more[by][1:] != more[by][:-1])])
        else:
            by = np.argsort(keys, kind="stable")
            new = np.concatenate([[True], np.diff(keys[by]) != 0])
        group = np.empty(len(keys), np.int64)
        group[by] = np.cumsum(new) - 1
        fit, deleted = (np.bincount(group, np.concatenate([unpacked(r[c], n) for r, n in zip(rows, ns, strict=True)])).astype(np.uint64) for c in ("fit", "deleted"))
        every, at, out = fit + deleted, np.cumsum([0, *ns]), []
        words = (int((fit > 0).sum()), int((every > 0).sum())) if rows[0]["order"] == 1 else (0, 0)
        for i, r in enumerate(rows):
            own = group[at[i] : at[i + 1]]
            out.append([r["chunk"], r["range"], r["order"], packed(deleted[own]), packed(every[own]), *(words if i == 0 else (0, 0))])
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in ANSWERS.split(", ")])

    return add


def digits(counts: np.ndarray) -> np.ndarray:
    """Bucket of a frequency: the number of its binary digits, 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def ratios(counts: list[np.ndarray], contexts: list[np.ndarray]) -> list[np.ndarray]:
    """Maximum-likelihood estimates; 0 in a context that was never met."""
    return [np.where(c > 0, n / np.maximum(c, 1), 0.0) for n, c in zip(counts, contexts, strict=True)]


def situations(order: int, ranges: int, tokens: int, docs: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deleted tokens as (buckets, counts, counts of contexts, number), once for each situation of a chunk."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(row, order, ranges)
                fit, _ = grams.answered(row["answers"])
                contexts, own = grams.of_contexts(fit, tokens, docs), grams.parts == DELETED
                cells = np.stack([x[own] for x in (*map(digits, contexts), *fit, *contexts)], axis=1)
                cells, n = np.unique(cells, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cells.T), pa.array(n)], names=[*[f"{c}{k}" for c in "bnc" for k in range(1, order + 1)], "n"])

    return gather


def learned(held: DataFrame, order: int, words: int, rounds: int = 30, least: float = 1e-4) -> list[list[float]]:
    """lambda of each order and bucket by expectation-maximisation over situations (b1, ..., n1, ..., c1, ..., n).

    In each round a situation's mass is dealt to the links of its chain; sums per combination of buckets, which are few,
    come to the driver. A bucket without a deleted token takes the lambda of all buckets of its order together; the
    bucket of contexts that were never met has 0. Rounded to 6 digits, so that the order of sums is of no consequence.
    """
    known = [[0.0] + [0.5] * (PLACES - 1) for _ in range(order)]
    for _ in range(rounds):
        rest, links = F.lit(1.0), []
        for k in range(order, 0, -1):
            weight = F.get(F.array(*[F.lit(x) for x in known[k - 1]]), F.col(f"b{k}").cast("int"))
            estimate = F.when(F.col(f"c{k}") > 0, F.col(f"n{k}") / F.col(f"c{k}")).otherwise(0.0)
            links.append((rest * weight * estimate).alias(f"r{k}"))
            rest = rest * (1 - weight)
        links.append((rest / (words + 1)).alias("r0"))
        shares = held.select(*[f"b{k}" for k in range(1, order + 1)], "n", *links)
        whole = sum((F.col(f"r{k}") for k in range(1, order + 1)), F.col("r0"))
        sums = shares.groupBy(*[f"b{k}" for k in range(1, order + 1)]).agg(*[F.sum(F.col("n") * F.col(f"r{k}") / whole).alias(f"r{k}") for k in range(order + 1)]).collect()
        new = []
        for k in range(1, order + 1):
            own, under = defaultdict(float), defaultdict(float)
            for r in sums:
                for b in {r[f"b{k}"], PLACES} if r[f"b{k}"] else ():  # PLACES: all buckets
                    own[b] += r[f"r{k}"]
                    under[b] += sum(r[f"r{j}"] for j in range(k + 1))
            value = lambda b: own[b] / under[b] if under[b] > 0 else 0.5  # noqa: E731, B023
            new.append([0.0] + [round(value(b if under[b] > 0 else PLACES), 6) for b in range(1, PLACES)])
        change = max(abs(x - y) for a, b in zip(known, new, strict=True) for x, y in zip(a, b, strict=True))
        known = new
        if change < least:
            break
    return known


def scoring(order: int, ranges: int, known: list[list[float]], tokens: int, docs: int, words: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grams = Grams(row, order, ranges)
                _, every = grams.answered(row["answers"])
                contexts = grams.of_contexts(every, tokens, docs)
                p = np.full(len(grams.parts), 1 / (words + 1))
                for k, estimate in enumerate(ratios(every, contexts)):
                    weight = np.array(known[k])[digits(contexts[k])]
                    p = weight * estimate + (1 - weight) * p
                base = np.log10((every[0] + 0.1) / (tokens + 0.1 * (words + 1)))
                doc = np.repeat(np.arange(len(grams.docs)), grams.lengths)
                total = lambda x: np.bincount(doc, x, len(grams.docs))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.docs, pa.int64()), pa.array(grams.doc_parts == HELD_OUT), pa.array(grams.lengths), pa.array(total(every[0] > 0).astype(np.int64)), pa.array(np.full(len(grams.docs), tokens)), pa.array(total(base)), pa.array(total(np.log10(p)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def scored(docs: DataFrame, order: int = 2, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, at_once: int = RANGE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Words are split at white space and A-Z lower-cased; an end is a token of every text. Null texts count as empty: they
    have the end alone. A null id counts as the empty text for the choice of held-out rows. Repeated rows count and are
    scored each time; other columns are not read. Texts are read whole: one of more than ``chunk`` tokens is a chunk of its
    own. An empty table gives no rows; without training texts all probabilities are uniform, and a lambda that no deleted
    token speaks for is 0.5. Words are told apart by 96-bit hashes, longer n-grams by 64-bit hashes of these.
    """
    spark = docs.sparkSession
    with tidied(spark) as kept:
        rows = narrowed(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), part_of("doc_id").alias("part"), "text")
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
        chunks = bucketed(rows.mapInArrow(chunking(chunk), CHUNKS_SQL), "chunks", "chunk", buckets)
        asked = chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        ranges = max(1, -(-asked // at_once))
        questions = chunks.select("chunk", "docs", "parts", "lengths", "tokens", "words").mapInArrow(asking(order, ranges), QUESTIONS)
        answers = questions.groupBy("range", "order").applyInArrow(adding(ranges), ANSWERS)
        cell = F.struct("range", "order", "deleted", "every")
        answers = answers.repartition(buckets, "chunk").groupBy("chunk").agg(F.collect_list(cell).alias("answers"), F.sum("fit_words").alias("fit_words"), F.sum("every_words").alias("every_words"))
        answers = bucketed(answers, "answers", "chunk", buckets)
        told = chunks.join(answers.select("chunk", "answers"), "chunk").drop("n")
        # totals: tokens and texts of the fitted and of all training texts
        totals = chunks.select("parts", "lengths").mapInArrow(of_parts, "part int, docs long, tokens long").groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).collect()
        n_docs, n_tokens = ({r["part"]: r[c] for r in totals} for c in ("docs", "tokens"))
        words = answers.agg(F.coalesce(F.sum("fit_words"), F.lit(0)).alias("fit"), F.coalesce(F.sum("every_words"), F.lit(0)).alias("every")).first()
        fit = (n_tokens.get(FIT, 0), n_docs.get(FIT, 0))
        held_sql = ", ".join([f"{c}{k} long" for c in "bnc" for k in range(1, order + 1)] + ["n long"])
        held = written(told.mapInArrow(situations(order, ranges, *fit), held_sql), "situations")
        known = learned(held, order, words["fit"])
        every = (fit[0] + n_tokens.get(DELETED, 0), fit[1] + n_docs.get(DELETED, 0))
        out = told.mapInArrow(scoring(order, ranges, known, *every, words["every"]), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        kept.append(written(out, "scores"))
    return kept[0]


def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and tokens of each part of each chunk."""
    for batch in batches:
        docs, tokens = np.zeros(3, np.int64), np.zeros(3, np.int64)
        for parts, lengths in zip(batch.column("parts").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
            part = np.frombuffer(parts, np.uint8)
            docs += np.bincount(part, minlength=3)
            tokens += np.bincount(part, np.frombuffer(lengths, "<u4"), 3).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2], pa.int32()), pa.array(docs), pa.array(tokens)], names=["part", "docs", "tokens"])
