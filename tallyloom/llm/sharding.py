"""Shards by balanced label propagation, in DataFrame functions only.

Documents that share a hub (here: equal texts) are linked. Every document starts in a shard given by its hash; each
round joins hubs with the sizes of their parts in every shard and moves whole parts towards the shard where most of the
hub lies, as far as the shards' quotas let them. Rows of one hub in one shard are alike, so the state is a row for each
(hub, shard) with a count, however many documents a hub has. Hubs of at least 1/LARGE of a shard, of which there are few,
are given places before that, the largest first; only one that fits no shard is cut. At last each shard takes its hubs'
documents, and documents without a partner fill what is left of it, so that counts are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import HOT_PART, hot_join, small, tidied, written

#: Rows of a bucket that one window task numbers, and buckets whose counts one window task sums.
BUCKET_ROWS, SUPER = 20_000, 1024
#: A hub is large if it has at least this part of a shard's documents: a shard has at most so many.
LARGE = 50


def share(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003.0


def shares(total: int, shards: int) -> list[int]:
    """Documents of each shard; the first ones have one more where total is no multiple."""
    low, extra = divmod(total, shards)
    return [low + (s < extra) for s in range(shards)]


def places(sizes: list[tuple[int, int]], free: list[int]) -> list[tuple[int, int, int]]:
    """(hub, shard, n) for hubs of (hub, size), the largest first into the emptiest shard; free is lowered by them.

    A hub that fits no shard is cut into as few parts as the free room allows.
    """
    out = []
    for hub, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        while size > 0:
            to = max(range(len(free)), key=lambda s: (free[s], -s))
            n = min(size, free[to])
            out.append((hub, to, n))
            free[to] -= n
            size -= n
    return out


def table(spark: SparkSession, rows: list[tuple[int, int, int]]) -> DataFrame:
    """A few (hub, shard, n) as literals."""
    kind = "array<struct<hub:bigint,shard:int,n:bigint>>"
    cells = F.array(*[F.struct(F.lit(h).cast("long").alias("hub"), F.lit(s).alias("shard"), F.lit(n).cast("long").alias("n")) for h, s, n in rows])
    return spark.range(1).select(F.explode(cells.cast(kind)).alias("c")).select("c.*")


def propagate(cells: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """Cells (hub, shard, n) after some rounds of moves of whole cells; room: documents that each shard may hold."""
    loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    for turn in range(rounds):
        hub = Window.partitionBy("hub")  # a row per shard at most
        wish = F.max(F.struct(F.col("n"), F.xxhash64("hub", "shard"), F.col("shard").alias("to"))).over(hub)["to"]
        moves = cells.withColumn("to", wish)
        # shards x shards rows: how much wants to go where
        flow = {(r["shard"], r["to"]): r["n"] for r in moves.filter("shard <> to").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        if not flow:
            break
        # what leaves makes room for as much to come: exchanges first, then free room
        allowed = {(a, b): min(n, flow.get((b, a), 0)) for (a, b), n in flow.items()}
        after = {s: loads.get(s, 0) + sum(n for (_, b), n in allowed.items() if b == s) - sum(n for (a, _), n in allowed.items() if a == s) for s in range(len(room))}
        for (a, b), n in sorted(flow.items()):
            extra = max(0, min(n - allowed[a, b], room[b] - after[b]))
            allowed[a, b] += extra
            after[b] += extra
            after[a] -= extra
        part = F.try_element_at(F.create_map(*[F.lit(x) for (a, b), n in flow.items() for x in (f"{a}>{b}", allowed[a, b] / n)]), F.concat_ws(">", "shard", "to"))
        goes = share("hub", "shard", F.lit(turn)) < F.coalesce(part, F.lit(0.0))
        cells = written(moves.select("hub", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"), "n").groupBy("hub", "shard").agg(F.sum("n").alias("n")), "cells")
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return cells


def before_each(counts: DataFrame) -> DataFrame:
    """lane, bucket, cut and before, the rows of earlier buckets and cuts of the lane; summed in two levels."""
    counts = counts.withColumn("super", F.expr(f"bucket div {SUPER}"))
    sums = counts.groupBy("lane", "super").agg(F.sum("n").alias("n"))
    upto = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy("lane", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("lane", "super", upto(["super"]).alias("base"))
    return counts.withColumn("inner", upto("super", ["bucket", "cut"])).join(sums, ["lane", "super"]).select("lane", "bucket", "cut", (F.col("base") + F.col("inner")).alias("before"))


def assign_shards(rows: DataFrame, hub: list[str], key: str, shards: int = 8, rounds: int = 4) -> DataFrame:
    """rows with shard (counts at most one apart) and slot (from 0 in each shard, without gaps).

    hub: the columns that linked rows share; a hub with a null column links nothing. Linked rows lie in one shard unless
    they are more than fit there, or more hubs than fit whole fill the shards. Repeated rows are placed one by one; an
    empty table stays empty. rows should come from a written table: they are read several times.
    """
    spark, total = rows.sparkSession, rows.count()
    size = shares(total, shards)
    with tidied(spark) as kept:
        code = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in hub], F.lit(0)) == 0, F.xxhash64(*hub)).otherwise(F.xxhash64(key, *hub, F.lit("alone")))
        placed = rows.withColumn("hub", code)
        hubs = written(placed.groupBy("hub").agg(F.count("*").alias("all")).filter("all > 1"), "hubs")
        large = F.col("all") * LARGE * shards >= total
        room = list(size)
        cut = places([(r["hub"], r["all"]) for r in hubs.filter(large).collect()], room)  # at most LARGE a shard
        # the others start where there is room, in proportion to it
        edges = [sum(room[: s + 1]) / max(1, sum(room)) for s in range(shards)]
        start = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= share(key, *hub))), F.lit(shards - 1))
        cells = placed.groupBy("hub", start.alias("shard")).agg(F.count("*").alias("n")).join(hubs.filter(~large).select("hub"), "hub")
        cells = propagate(written(cells, "cells"), room, rounds).select("hub", "shard", "n").unionByName(table(spark, cut))
        # a document of a hub takes the part whose share of the hub holds its hash
        upto = F.sum("n").over(Window.partitionBy("hub").orderBy("shard")) / F.sum("n").over(Window.partitionBy("hub"))
        parts = cells.withColumn("upto", upto).groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("parts"), F.sum("n").alias("n"))  # at most a part per shard
        parts = written(parts.select("hub", "parts", (F.col("n") * HOT_PART >= total).alias("hot")), "parts")
        aimed = hot_join(placed, parts, ["hub"], "left")
        u = share(F.lit("part"), key, *hub)
        aim = F.get(F.filter("parts", lambda p: p["upto"] > u), F.lit(0))["shard"]
        # lanes: the documents of hubs by shard, and those without a partner
        buckets = max(1, total // BUCKET_ROWS)
        # hubs that lie in several shards come last in their lanes: if a lane is too long, it is these that give way
        bucket = F.pmod("hub", F.lit(buckets)) + F.when(F.size("parts") > 1, F.lit(buckets)).otherwise(F.lit(0))
        placed = aimed.withColumn("lane", F.coalesce(aim, F.lit(shards))).withColumn("bucket", bucket).drop("parts")
        placed = written(placed, "placed")
        # buckets that a large hub fills are cut by the rows' hashes
        sizes = placed.groupBy("lane", "bucket").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("cuts"))
        placed = placed.join(small(sizes, 2 * buckets * (shards + 1)), ["lane", "bucket"]).withColumn("cut", F.pmod(F.xxhash64(key, F.lit("cut")), F.col("cuts"))).drop("cuts")
        order = ["lane", "bucket", "cut"]
        counts = written(placed.groupBy(*order).agg(F.count("*").alias("n")), "counts")
        lanes = {r["lane"]: r["n"] for r in counts.groupBy("lane").agg(F.sum("n").alias("n")).collect()}  # a row per lane
        offsets = before_each(counts)
        local = F.row_number().over(Window.partitionBy(*order).orderBy("hub", key, *hub)) - 1
        ranked = placed.join(small(offsets, 3 * buckets * (shards + 1)), order).withColumn("rank", F.col("before") + local)
        held = [min(lanes.get(s, 0), size[s]) for s in range(shards)]
        over = [lanes.get(s, 0) - held[s] for s in range(shards)]
        free = [size[s] - held[s] for s in range(shards)]
        at = lambda values, i: F.get(F.array(*[F.lit(v).cast("long") for v in values]), i)
        # what does not fit its own shard comes after those without a partner
        pool = F.when(F.col("lane") == shards, F.col("rank")).otherwise(lanes.get(shards, 0) + at([sum(over[:s]) for s in range(shards)], F.col("lane")) + F.col("rank") - at(size, F.col("lane")))
        inside = (F.col("lane") < shards) & (F.col("rank") < at(size, F.col("lane")))
        filled = F.size(F.filter(F.array(*[F.lit(sum(free[: s + 1])).cast("long") for s in range(shards)]), lambda c: c <= F.col("pool")))
        ranked = ranked.withColumn("pool", F.when(~inside, pool))
        ranked = ranked.withColumn("shard", F.when(inside, F.col("lane")).otherwise(filled).cast("int"))
        slot = F.when(inside, F.col("rank")).otherwise(at(held, F.col("shard")) + F.col("pool") - at([sum(free[:s]) for s in range(shards)], F.col("shard")))
        kept.append(written(ranked.withColumn("slot", slot).select(*rows.columns, "shard", "slot"), "sharded"))
        return kept[0]


def cut_edges(sharded: DataFrame, hub: list[str]) -> DataFrame:
    """One row: pairs of linked rows, and how many of them lie in two shards, from counts."""
    pairs = lambda n: (F.col(n).cast("decimal(38,0)") * (F.col(n) - 1) / 2).cast("decimal(38,0)")
    cells = sharded.dropna(subset=hub).groupBy(*hub, "shard").agg(F.count("*").alias("n")).withColumn("same", pairs("n"))
    hubs = cells.groupBy(*hub).agg(F.sum("n").alias("n"), F.sum("same").alias("same")).withColumn("every", pairs("n"))
    return hubs.agg(F.coalesce(F.sum("every"), F.lit(0)).cast("long").alias("n_edges"), F.coalesce(F.sum(F.col("every") - F.col("same")), F.lit(0)).cast("long").alias("n_cut"))


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32, shard and slot of every row; equal texts are kept together.

    A null text counts as empty and, like the empty text, is linked with other empty ones. Null and repeated ids are
    placed like any other row. A text of any length is one value; an empty table gives no rows. n_edges and n_cut, on every
    row, are the pairs of rows with equal texts and those of them that lie in two shards.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash"))
    with tidied(docs.sparkSession) as kept:
        kept.append(assign_shards(written(rows, "rows"), ["text_hash", "text_crc32", "size"], "doc_id", shards))
    edges = cut_edges(kept[0], ["text_hash", "text_crc32", "size"])
    return kept[0].drop("text_hash").crossJoin(F.broadcast(edges))  # one row
