"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard, results merged.

Vectors are dealt by a hash to SHARDS shards, or to more, so that none holds over about SHARD_ROWS (a graph of that many
vectors of 64 components takes about 120 MB). So the shards that a query is searched in stay at SHARDS up to SHARDS x
SHARD_ROWS vectors and then grow with the table at 1 in SHARD_ROWS. Equal vectors are one node, with the smallest ids that can
still reach a result (rank + 1 of them: ties go to the smaller id, so the others never can). A graph is flat arrays:
ids, vectors, and per level the neighbours of every node, padded. Largest inner product is turned into least distance
by one more component, sqrt(M**2 - |x|**2) with M the shard's largest norm, and 0 for queries.

Every query is searched in every shard's graph, as a stream of query rows behind the shard's index row, in blocks of
about QUERY_ROWS queries, so a task holds one graph and one batch and no task has all queries of a large table. Scores of what is found are inner products of the original vectors in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as candidates or
queries; vectors of different length are never compared; fewer candidates than asked for are all returned; rows that
repeat an id are one candidate, whose score is its best, and one query, whose results are the best of its vectors', and
none of them is a candidate of its own id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import table, written

SHARDS = 8
SHARD_ROWS = 1 << 17
QUERY_ROWS = 1 << 14
TOP = 20
M = 16
EF_BUILD = 60
EF_SEARCH = 80


def breadth(nodes: int, ef: int = EF_SEARCH) -> int:
    """How many candidates a search holds. On vectors without structure recall falls with a graph's size at a fixed
    breadth; at ef * sqrt(nodes / 4096) it was 0.96 for 6,400 nodes and 0.92 for 20,000 and for 51,000 (64 components)."""
    return max(ef, math.ceil(ef * math.sqrt(nodes / 4096)))


class Graph:
    """Flat arrays: x (nodes x dimensions + 1), low (nodes x 2 M neighbours, -1: none), high[level] likewise with M."""

    def __init__(self, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 3):
        v = np.asarray(vectors, np.float64)
        norms = (v * v).sum(axis=1)
        self.x = np.hstack([v, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]]).astype(np.float32)
        n = len(v)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int), 6)
        self.m, self.entry, self.top = m, 0, int(levels[0])
        self.layers = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(levels.max()) + 1)]
        self.sizes = [np.zeros(n, np.int32) for _ in self.layers]
        for i in range(1, n):
            self._insert(i, int(levels[i]), ef)

    def _near(self, q: np.ndarray, ids) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _greedy(self, q: np.ndarray, at: int, level: int) -> int:
        best = float(self._near(q, [at])[0])
        while True:
            near = self.layers[level][at, : self.sizes[level][at]]
            if not len(near):
                return at
            d = self._near(q, near)
            k = int(d.argmin())
            if d[k] >= best:
                return at
            best, at = float(d[k]), int(near[k])

    def _search(self, q: np.ndarray, start: list[int], level: int, ef: int) -> list[tuple[float, int]]:
        layer, sizes = self.layers[level], self.sizes[level]
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        first = self._near(q, start)
        todo = [(float(d), i) for d, i in zip(first, start, strict=True)]
        heapq.heapify(todo)
        found = [(-d, i) for d, i in todo]
        heapq.heapify(found)
        while todo:
            d, at = heapq.heappop(todo)
            if len(found) >= ef and d > -found[0][0]:
                break
            near = layer[at, : sizes[at]]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            for dist, i in zip(self._near(q, near).tolist(), near.tolist(), strict=True):
                if len(found) < ef:
                    heapq.heappush(found, (-dist, i))
                    heapq.heappush(todo, (dist, i))
                elif dist < -found[0][0]:
                    heapq.heapreplace(found, (-dist, i))
                    heapq.heappush(todo, (dist, i))
        return sorted((-d, i) for d, i in found)

    def _choose(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes that are closer to the new one than to any chosen before; then the nearest others."""
        ids = np.array([i for _, i in near])
        if len(ids) <= most:
            return ids.tolist()
        v = self.x[ids]
        sq = np.einsum("ij,ij->i", v, v)
        between = sq[:, None] + sq[None] - 2 * (v @ v.T)
        kept: list[int] = []
        closest = np.full(len(ids), np.inf)
        for k, (d, _) in enumerate(near):
            if d < closest[k]:
                kept.append(k)
                closest = np.minimum(closest, between[k])
                if len(kept) == most:
                    break
        chosen = set(kept)
        kept += [k for k in range(len(ids)) if k not in chosen][: most - len(kept)]
        return ids[kept].tolist()

    def _insert(self, i: int, level: int, ef: int) -> None:
        q, at = self.x[i], self.entry
        for k in range(self.top, level, -1):
            at = self._greedy(q, at, k)
        start = [at]
        for k in range(min(level, self.top), -1, -1):
            near = self._search(q, start, k, ef)
            layer, sizes = self.layers[k], self.sizes[k]
            chosen = self._choose(near, self.m)
            layer[i, : len(chosen)], sizes[i] = chosen, len(chosen)
            for j in chosen:
                n = int(sizes[j])
                if n < layer.shape[1]:
                    layer[j, n], sizes[j] = i, n + 1
                else:
                    ids = np.append(layer[j], i)
                    d = self._near(self.x[j], ids)
                    order = np.argsort(d, kind="stable")
                    kept = self._choose([(float(d[o]), int(ids[o])) for o in order], layer.shape[1])
                    layer[j, : len(kept)], sizes[j] = kept, len(kept)
            start = [i for _, i in near]
        if level > self.top:
            self.top, self.entry = level, i

    def nearest(self, q: np.ndarray, ef: int) -> list[int]:
        """Nodes that a search of breadth ef finds for a plain vector, nearest first."""
        q = np.append(q, 0).astype(np.float32)
        at = self.entry
        for k in range(self.top, 0, -1):
            at = self._greedy(q, at, k)
        return [i for _, i in self._search(q, [at], 0, ef)]


def usable(v: str) -> Column:
    c = F.col(v)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.col("v")), F.lit(shards)).cast("int")


def build(vectors: DataFrame, shards: int, keep: int = TOP + 1) -> DataFrame:
    """One row per shard and vector length: shard, size, graph (pickled flat arrays). vectors: id long, v array<double>."""

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Equal vectors of a batch become one row with their smallest ids, so copies do not gather in one task."""
        for b in batches:
            groups: dict[bytes, list[int]] = {}
            for i, v in zip(b["id"], b["v"], strict=True):
                groups.setdefault(np.asarray(v, np.float64).tobytes(), []).append(i)
            shard = dict(zip((np.asarray(v, np.float64).tobytes() for v in b["v"]), b["shard"], strict=True))
            yield pd.DataFrame({"shard": [shard[k] for k in groups], "size": [len(k) // 8 for k in groups], "key": list(groups), "ids": [sorted(set(x))[:keep] for x in groups.values()]})

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        merged: dict[bytes, set[int]] = {}
        for key, ids in zip(pdf["key"], pdf["ids"], strict=True):
            merged.setdefault(key, set()).update(ids)
        keys = sorted(merged, key=lambda k: min(merged[k]))
        vectors = np.frombuffer(b"".join(keys)).reshape(len(keys), -1)
        blob = pickle.dumps((Graph(vectors), vectors, [sorted(merged[k])[:keep] for k in keys]), protocol=5)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "size": [int(pdf["size"].iloc[0])], "graph": [blob]})

    rows = vectors.select("id", "v", shard_of(shards).alias("shard")).mapInPandas(collapse, "shard int, size int, key binary, ids array<long>")
    return rows.groupBy("shard", "size").applyInPandas(graph, "shard int, size int, graph binary")


def search(index: DataFrame, queries: DataFrame, shards: int, top: int = TOP, ef: int = EF_SEARCH, own: bool = False, blocks: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score. queries: id long, v array<double>. own: may a query find its own id? The queries are
    dealt to so many blocks, each of which is searched in each shard's graph by a task."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int")
    q = queries.select(every(shards).alias("shard"), F.size("v").alias("size"), block.alias("block"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("graph"))
    g = index.select("shard", "size", every(blocks).alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "graph")
    stream = g.unionByName(q).repartition("shard", "size", "block").sortWithinPartitions("shard", "size", "block", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, None
        for b in batches:
            out = []
            for shard, size, block, kind, i, v, blob in zip(b["shard"], b["size"], b["block"], b["kind"], b["id"], b["v"], b["graph"], strict=True):
                if kind == 0:
                    at, held = (shard, size, block), pickle.loads(blob)
                    continue
                if at != (shard, size, block):
                    continue  # no vector of this length in the shard
                found, vectors, ids = held
                q = np.asarray(v, np.float64)
                near = found.nearest(q, breadth(len(vectors), ef))
                scores = vectors[near] @ q
                hits: dict[int, float] = {}  # each id once, with its best score
                for s, j in sorted((-s, j) for s, k in zip(scores.tolist(), near, strict=True) for j in ids[k] if own or j != i):
                    if hits.setdefault(j, -s) == -s and len(hits) == top:
                        break
                out += [(int(i), j, s) for j, s in hits.items()]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = stream.mapInPandas(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 20, top: int = TOP, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, at_least: int = SHARDS) -> DataFrame:
    """The nearest of every row whose id is divisible by ``every``, among all rows. embeddings: vec_id, embedding."""
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = F.col("id") % every == 0
    n = rows.agg(F.count("*").alias("all"), F.count_if(asked).alias("asked")).first()
    shards = max(at_least, -(-n["all"] // shard_rows))
    index = written(build(rows, shards, top + 1))
    return search(index, rows.where(asked), shards, top, blocks=max(1, -(-n["asked"] // query_rows)))


def query(spark, sf_dir) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))

