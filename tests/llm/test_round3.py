"""Trie, clusters and language model against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import clusters, trie


def same_as_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(name, t.toArrow())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want, got = sorted(map(str, rel.fetchall())), sorted(str(tuple(r)) for r in df.select(*names).collect())
    assert got == want
    return len(got)


def conversations(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "a b", "  \n ", "é\x0bü c", "y " * 4000]
    rows = [(c, t, rng.choice(["user", None, "assistant"]), rng.choice(texts)) for c in [0, 20, 40, 60, -20] for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"open {t % 3}" if t < 12 else rng.choice(texts)) for c in range(1, 45, 3) for t in range(rng.randint(1, 30))]
    rows += [(c, 0, "user", "hot") for c in range(100, 160)] + [(-7, 1, "user", "x"), (-7, None, "user", "y"), (-7, None, "user", "y"), (-7, 1, "user", "w")]
    rows += [(None, 0, "user", "lost"), rows[0], rows[3], (777, 5, None, None)] + [(900, t, "user", str(t)) for t in range(16)] + [(901, t, "user", str(t)) for t in range(17)]
    return spark.createDataFrame([r + ("clash", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, level int")


def brute_trie(rows):
    """Every prefix of every rebuilt conversation in a dictionary, subtrees by comparing prefixes."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            x = hashlib.sha256((hashlib.sha256((role or "").encode()).hexdigest() + (text or "")).encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, x), (role or "", text or "")))
    turns = {c: [v for _, v in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        source = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(source, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, w in whole.items():
        for d in range(len(w) + 1):
            members[w[:d]].append(c)
    blank = str.maketrans("\x0b\x0c\t\n\r", "     ")
    saved = {k: (len(m) - 1) * (len([x for x in k[-1][1].translate(blank).split(" ") if x]) if k else 0) for k, m in members.items()}
    parents = {k[:-1] for k in members if k}
    out = []
    for k, m in members.items():
        under = [z for z in members if z[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), sum(z[:-1] == k for z in members if z), sum(z not in parents for z in under), sum(saved[z] for z in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def test_trie_against_every_prefix(spark):
    rows = conversations(spark)
    got = trie.conversation_trie(rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_trie([tuple(r)[:4] for r in rows.collect()])
    assert same_as_sql(got, trie.TRIE_SQL, conversations=rows) == got.count() > 100
    assert trie.conversation_trie(rows.limit(0)).count() == 0


def test_trie_pieces_of_long_lists(spark, monkeypatch):
    """The hash of a node's list is the same, however the list is cut."""
    import pyarrow as pa

    ids = list(range(1000))
    batches = [pa.RecordBatch.from_arrays([pa.array([b"k"] * 10, pa.binary()), pa.array(ids[i : i + 10])], names=["key", "conv_id"]) for i in range(0, 1000, 10)]
    monkeypatch.setattr(trie, "PIECE", 50)
    pieces = list(trie.joined_ids(iter(batches)))
    assert sum(p.num_rows for p in pieces) > 50
    (row,) = [r for b in trie.hashed_runs(iter(pieces)) for r in b.to_pylist()]
    assert row["ends"] == hashlib.sha256(",".join(map(str, ids)).encode()).digest()


def vectors(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(64)]) for i in range(n)]
    same = rows[0][1]
    rows += [(i, same) for i in range(n, n + 30)] + [rows[1], rows[1], (n + 40, None), (n + 41, []), (n + 42, same[:63]), (n + 43, same + [0.0]), (n + 44, [None] + same[1:]), (n + 45, [float("nan")] + same[1:]), (n + 46, [float("-inf")] + same[1:])]
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")


@pytest.mark.parametrize("n", [300, 20])
def test_clusters_against_sql(spark, n):
    rows = vectors(spark, n)
    assert same_as_sql(clusters.cluster(rows), clusters.cluster_sql(), embeddings=rows) == n + 32


def test_clusters_odd_rows(spark):
    rows = vectors(spark, 60)
    assert clusters.cluster(rows.limit(0)).count() == 0
    with_null = rows.filter("vec_id < 10").unionByName(rows.filter("vec_id = 3").withColumn("vec_id", F.lit(None).cast("long")))
    got = clusters.cluster(with_null, k=4, rounds=2).collect()
    assert len({r.cluster for r in got if r.vec_id in (3, None)}) == 1 and len(got) == with_null.count()
    huge = rows.limit(1).withColumn("embedding", F.transform("embedding", lambda x: F.lit(1e30)))
    with pytest.raises(Exception, match="lies beyond"):
        clusters.cluster(huge).count()


def texts(spark, n=240):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(25)]
    made = [" ".join(rng.choice(words[: 2 + i % 24]) for i in range(rng.randint(0, 40))) for _ in range(n)]
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in enumerate(made)]
    rows += [(None, "w1 w2"), (3, None), (3, ""), (5, " \t\x0b\n "), (6, "É\xa0w1 new"), (7, rows[4][1]), (7, rows[4][1]), (n + 1, "w0 w1 " * 3000)]
    return rows, spark.createDataFrame([r + (1, "clash") for r in rows], "doc_id long, text string, part int, words string").repartition(4)


def brute_scores(rows, order):
    """Deleted interpolation with dictionaries and a loop over tokens."""
    import math
    import re

    def part(i):
        code = zlib.crc32(("" if i is None else str(i)).encode())
        return 0 if code % 10 == 0 else 1 if code // 10 % 10 == 0 else 2

    docs = [(i, part(i), [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [0]) for i, t in rows]

    def counted(parts):
        n = defaultdict(int)
        for _, p, ws in docs:
            if p in parts:
                full = ["<"] * (order - 1) + ws
                for at in range(order - 1, len(full)):
                    for k in range(1, order + 1):
                        n[tuple(full[at - k + 1 : at + 1])] += 1
                        n[k, tuple(full[at - k + 1 : at])] += 1  # of the context
        return n

    def chain(n, ws):
        full = ["<"] * (order - 1) + ws
        for at in range(order - 1, len(full)):
            cs = [n.get((k, tuple(full[at - k + 1 : at])), 0) for k in range(1, order + 1)]
            yield [c.bit_length() for c in cs], [n.get(tuple(full[at - k + 1 : at + 1]), 0) / c if c else 0.0 for k, c in zip(range(1, order + 1), cs)]

    size = lambda n: sum(1 for g in n if len(g) == 1)
    fit, every = counted({2}), counted({1, 2})
    lam = [[0.0] + [0.5] * 63 for _ in range(order)]
    seen = [s for _, p, ws in docs if p == 1 for s in chain(fit, ws)]
    for _ in range(30):
        own, under = [defaultdict(float) for _ in range(order)], [defaultdict(float) for _ in range(order)]
        for bs, ps in seen:
            rest, r = 1.0, [0.0] * (order + 1)
            for k in range(order, 0, -1):
                r[k] = rest * lam[k - 1][bs[k - 1]] * ps[k - 1]
                rest *= 1 - lam[k - 1][bs[k - 1]]
            r[0] = rest / (size(fit) + 1)
            for k in range(1, order + 1):
                for b in {bs[k - 1], 64} if bs[k - 1] else ():
                    own[k - 1][b] += r[k] / sum(r)
                    under[k - 1][b] += sum(r[: k + 1]) / sum(r)
        new = [[0.0] + [round(o[b if u[b] > 0 else 64] / u[b if u[b] > 0 else 64], 6) if u[64] > 0 else 0.5 for b in range(1, 64)] for o, u in zip(own, under)]
        change = max(abs(x - y) for a, b in zip(lam, new) for x, y in zip(a, b))
        lam = new
        if change < 1e-4:
            break
    total, v = sum(c for g, c in every.items() if len(g) == 1), size(every)
    out = []
    for i, p, ws in docs:
        score = 0.0
        for bs, ps in chain(every, ws):
            q = 1 / (v + 1)
            for k in range(order):
                q = lam[k][bs[k]] * ps[k] + (1 - lam[k][bs[k]]) * q
            score += math.log10(q)
        counts = [every.get((w,), 0) for w in ws]
        out.append((i, p == 0, len(ws), sum(c > 0 for c in counts), total, sum(math.log10((c + 0.1) / (total + 0.1 * (v + 1))) for c in counts), score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_dictionaries(spark, order):
    from tallyloom.llm import language

    rows, df = texts(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in language.scored(df, order, chunk=300, at_once=700).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=key)
    want = sorted(brute_scores(rows, order), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-5)
    held = [r for r in got if r[1] and r[2] > 5]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held) or order == 1


def test_language_model_odd_tables(spark):
    from tallyloom.llm import language

    _, df = texts(spark, 12)
    assert language.scored(df.limit(0)).count() == 0
    code = lambda i: zlib.crc32(str(i).encode()) % 10
    alone = [i for i in range(100) if code(i) == 0][:3]
    untrained = language.scored(spark.createDataFrame([(i, "a b") for i in alone], "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in untrained)


def test_packed_numbers():
    import numpy as np

    from tallyloom.llm import language

    for values in ([], [0], [255, 256, 0], [2**64 - 1, 5], [2**32]):
        a = np.array(values, np.uint64)
        assert (language.unpacked(language.packed(a), len(a)) == a).all()
    for ranges in (1, 3, 51, 1000):
        low = [language.lowest(r, ranges) for r in range(ranges)]
        assert all(((x >> 32) * ranges >> 32) == r and (r == 0 or ((x - 1 >> 32) * ranges >> 32) == r - 1) for r, x in enumerate(low))


def test_numbers_of_classes_that_collide(spark):
    from tallyloom.llm import jaccard

    classes = spark.createDataFrame([(i * 7919, i * 104729, i % 9) for i in range(40)], "text_hash long, other_hash long, size int")
    plain = F.shiftrightunsigned(F.xxhash64("text_hash", "other_hash", "size"), 64 - 9)
    assert classes.select(plain.alias("c")).distinct().count() < 40  # some share 9 bits
    try:
        assert classes.select(jaccard.node_code(classes, 9).alias("c")).distinct().count() == 40
    except ValueError as e:
        assert "told apart" in str(e)
    assert classes.select(jaccard.node_code(classes).alias("c")).distinct().count() == 40


def test_leaves_of_repeated_ids_are_refused(spark):
    P = pytest.importorskip("public_tokenizers")
    from tallyloom.llm import counts

    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e f"), (2, "x y"), (None, "n")], "doc_id long, text string")
    leaves = counts.leaf_table(docs, path)
    edit = lambda i: spark.createDataFrame([(i, 0, 1, "q")], "doc_id long, position long, deleted long, inserted string")
    with pytest.raises(Exception, match="several rows"):
        counts.edited_leaves(leaves, edit(1), path).count()
    got = sorted((str(r.doc_id), r.text) for r in counts.edited_leaves(leaves, edit(2), path).collect())
    assert got == [("1", "a b c"), ("1", "d e f"), ("2", "q y"), ("None", "n")]
    assert counts.edited_leaves(leaves, edit(7), path).count() == 4 and counts.edited_leaves(leaves.limit(0), edit(1), path).count() == 0


def test_share_of_repeats_is_taken_as_it_is(spark):
    from tallyloom.llm import repetition

    words = [f"w{i}" for i in range(5)] * 2 + [f"u{i}" for i in range(54)]  # 10 of 64 words: 15.625 %
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    for most, kept in ((0.155, False), (0.157, True)):
        assert repetition.repetition_rules(df, most_covered=most).first().kept == kept and repetition.kept_documents(df, most_covered=most).count() == kept


def test_two_queries_at_once_keep_their_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from tallyloom.llm.queries import QUERIES

    names = ["op4_secrets", "op9_sharding", "op11_trie"]
    run = lambda n: QUERIES[n](spark, "/root/testdata/sf0.001").count()
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(run, names * 2))
    assert got[:3] == got[3:] and min(got) > 0
