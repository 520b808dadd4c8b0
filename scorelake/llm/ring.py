"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Law ``rows``: every shard may hold floor(n / shards) rows, the first n mod shards one more, so counts are at most one
apart. The ring has ``SLOTS`` places; md5 puts each shard on VNODES of them and each doc_id on one. A row belongs to
the next virtual node clockwise; rows that find its shard full go on clockwise to the next node whose shard has room.

How many rows of each slot go where depends on the slots' counts alone (SLOTS numbers, whatever the input's size), so
the overflow is worked out over these, giving at most SLOTS + shards * VNODES runs: slot, ranks, shard, first place in
the shard. Each row's rank in its slot (one window over slots, which the hash keeps even) then finds its run.

Defined cases: a null text has no bytes (size 16) and the crc32 of the empty text; a null doc_id is placed by its text,
so that rows without ids spread; equal texts under different doc_ids are
placed each by its own id, as law ``rows`` asks nothing else of them; rows with the same doc_id share a slot and are ranked by crc32 and size, and rows
equal in all of these are interchangeable; an empty table gives no rows; fewer rows than shards leave shards empty.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window, functions as F

from .common import table

SHARDS = 40
VNODES = 64
SLOTS = 1 << 14


def owners(shards: int, vnodes: int = VNODES, slots: int = SLOTS) -> list[int]:
    """The virtual nodes clockwise, as slot * shards + shard; of nodes on one slot, the smaller shard comes first."""
    at = lambda s, v: int(hashlib.md5(f"shard-{s}-{v}".encode()).hexdigest()[:8], 16) % slots
    return sorted({at(s, v) * shards + s for s in range(shards) for v in range(vnodes)})


def runs(counts: dict[int, int], shards: int, vnodes: int = VNODES, slots: int = SLOTS) -> list[tuple[int, int, int, int, int]]:
    """(slot, first rank, rank after the last, shard, place of the first rank in the shard).

    Pools of rows wait at virtual nodes. In each round every node, clockwise, takes what its shard has room for; the
    rest moves on to the next node. Rows that waited longer are taken first.
    """
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    held, out = [0] * shards, []
    ring = owners(shards, vnodes, slots)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in ring]
    k = 0
    for slot in sorted(counts):
        while k < len(ring) and ring[k] // shards < slot:
            k += 1
        waiting[k % len(ring)].append((slot, 0, counts[slot]))
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in ring]
        for k, pools in enumerate(waiting):
            s = ring[k] % shards
            for slot, a, b in pools:
                if (take := min(b - a, room[s] - held[s])) > 0:
                    out.append((slot, a, a + take, s, held[s]))
                    held[s] += take
                if a + take < b:
                    moved[(k + 1) % len(ring)].append((slot, a + take, b))
        waiting = moved
    return out


def slot_of(slots: int = SLOTS):
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("none"))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    counts = {r["ring"]: r["n"] for r in docs.groupBy(slot_of(slots).alias("ring")).agg(F.count("*").alias("n")).collect()}  # at most ``slots``
    names = ("ring", "low", "high", "shard", "base")
    found = json.dumps([dict(zip(names, r, strict=True)) for r in runs(counts, shards, vnodes, slots)])
    plan = spark.range(1).select(F.inline(F.from_json(F.lit(found), "array<struct<ring:int,low:long,high:long,shard:int,base:long>>")))
    rows = docs.select("doc_id", slot_of(slots).alias("ring"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("ring").orderBy("doc_id", "text_crc32", "size")).cast("long") - 1)
    placed = ranked.join(F.broadcast(plan), "ring").where("rank >= low and rank < high")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text"))
