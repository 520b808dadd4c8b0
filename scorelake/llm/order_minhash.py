"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is its sequence of five-word shingles (fewer words: one shingle of all), each labelled with how often it has
occurred before. For each of BANDS hash orders, the sketch takes the LEAST smallest labelled shingles and keeps them in
text order; documents with an equal band are candidates. Two documents are linked if L / (n + m - L) >= 0.8, where n
and m are their numbers of shingles and L is the length of the best alignment without crossings. That allows at most
(n + m) / 9 unmatched shingles, which bounds the band of diagonals that the alignment visits.

Equal texts, and texts with equal sequences of shingles, are one node. A bucket holds the nodes with one band. Its nodes
are ranked by how many others they share buckets with, so those in the middle of a group of copies come first. A round
takes the next nodes of a bucket as leaders (1, then 3, 12, 48 and so on) and holds the others against them, and classes
are formed anew. A leader has then met every node of its bucket, so it leaves it; a bucket whose nodes are of one class is
done. A node meets a leader only if it is of another class and passes two exact bounds, of length and of differing bits of
a bitmap of its shingles. Once 16 have been leaders, only nodes outside the bucket's largest class are: two classes meet
through such a node only, so a group of copies of any size is never spelled out into its pairs. The rounds end when no
bucket has two classes, so every pair of a bucket is decided: by a common class, by a bound that no similar pair fails, or
by its alignment.

Defined cases: a null text is alone in its class; texts without words are copies only of equal texts; texts of any length
are compared whole; rows that repeat a doc_id fall into one class if their texts do; rows without a doc_id get the
smallest doc_id of their class, null if it has none; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bound_batches, discard, table, words, written
from .components import components
from .pieces import Memo

BANDS = 16
LEAST = 3
WORDS = 5
SIMILARITY = 0.8
SURE = 16  # leaders of a bucket that may be of its largest class
GROWTH = 4
LENGTH_STEP = 1.26  # the width of a band of lengths; those of similar nodes differ by a factor of 1.25 at most
BIT_WORDS = 64  # the longest bitmap, in 64-bit words
_ODD = np.random.default_rng(20).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Shingler:
    def __init__(self, size: int = WORDS):
        self.size, self.memo = size, Memo(xxhash.xxh64_intdigest, 1 << 17)

    def __call__(self, text: str | None) -> np.ndarray:
        """64-bit shingles in text order."""
        w = words(text)
        h = np.fromiter(map(self.memo.__getitem__, w), np.uint64, len(w))
        k = min(self.size, len(w))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out + h[j : len(h) - k + 1 + j] * _ODD[j])
        return out


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle together with the number of its earlier occurrences, as one hash."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    if new.all():
        return shingles
    at = np.arange(len(s))
    seen = np.empty(len(s), np.uint64)
    seen[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(seen > 0, _mix(shingles + seen * _ODD[40]), shingles)


def sketch(shingles: np.ndarray, bands: int = BANDS, least: int = LEAST) -> list[int]:
    """One signed 64-bit key per band."""
    x = labelled(shingles)
    if len(x) > least:
        v = (x[None] ^ _ODD[:bands, None]) * _ODD[bands : 2 * bands, None]
        v ^= v >> np.uint64(32)
        at = np.sort(np.argpartition(v, least - 1, axis=1)[:, :least], axis=1)
        picked = x[at]
    else:
        picked = np.repeat(x[None], bands, axis=0)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(picked.shape[1]):
        key = _mix(key * _ODD[41] + picked[:, j])
    return key.view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Is the best alignment long enough? Only the band of diagonals that the similarity allows is looked at."""
    n, m = len(a), len(b)
    if not n or not m:
        return False
    most = int((n + m) * (1 - similarity) / (1 + similarity) + 1e-9)  # unmatched shingles
    if abs(n - m) > most:
        return False
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if n + m - 2 * int(np.minimum(nx[i], ny[j]).sum()) > most:
        return False
    if int((nx[i] * ny[j]).sum()) <= 16 * (n + m):
        return n + m - 2 * _by_matches(a.tolist(), b.tolist(), most) <= most
    return _by_diagonals(a, b, most)


def _by_matches(a: list[int], b: list[int], band: int) -> int:
    """Longest alignment inside the band, as a longest increasing run of matches; for sequences with few repeats."""
    places: dict[int, list[int]] = {}
    for j, v in enumerate(b):
        places.setdefault(v, []).append(j)
    tails: list[int] = []
    for i, v in enumerate(a):
        for j in reversed(places.get(v, ())):
            if -band <= i - j <= band:
                if not tails or j > tails[-1]:
                    tails.append(j)
                else:
                    tails[bisect_left(tails, j)] = j
    return len(tails)


def _by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Do at most ``most`` shingles stay unmatched? Furthest-reaching paths over the diagonals of the band."""
    n, m = len(a), len(b)
    breaks: dict[int, list[int]] = {}

    def run(k: int, i: int) -> int:
        """The end of the matches along diagonal k (i - j) from i."""
        if k not in breaks:
            lo, hi = max(k, 0), min(n, m + k)
            breaks[k] = (np.flatnonzero(a[lo:hi] != b[lo - k : hi - k]) + lo).tolist() + [hi]
        at = breaks[k]
        return at[min(bisect_left(at, i), len(at) - 1)]

    reach = {1: 0}
    for d in range(most + 1):
        new = {}
        for k in range(-d, d + 1, 2):
            if -m <= k <= n:
                i = max(reach.get(k + 1, -1), reach.get(k - 1, -2) + 1)
                if i < max(k, 0) or i > n or i - k > m:
                    continue
                i = run(k, i)
                if i == n and i - k == m:
                    return True
                new[k] = i
        reach = new
    return False


def nodes_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the node of each text; null for a null text."""
    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("node"))


def bitmap(x: np.ndarray) -> list[int]:
    """One bit per labelled shingle, in a power of two of words: texts that differ in d bits differ in d shingles or more."""
    size = 1
    while size < BIT_WORDS and size * 16 < len(x):
        size *= 2
    at = np.unique((x * _ODD[42]) >> np.uint64(64 - 6 - size.bit_length() + 1))
    out = np.zeros(size, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64).tolist()


def sketches(docs: DataFrame) -> DataFrame:
    """node, whole (hash of all shingles), n (shingles), keys, bits, for every text with words; docs: node, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        for b in batches:
            out = {}
            for node, text in zip(b["node"], b["text"], strict=True):
                if node not in out and len(s := shingle(text)):
                    out[node] = (xxhash.xxh128_digest(s.tobytes()), len(s), sketch(s), bitmap(labelled(s)))
            yield pd.DataFrame({"node": list(out), **{c: [v[k] for v in out.values()] for k, c in enumerate(("whole", "n", "keys", "bits"))}})

    rows = docs.where("node is not null").mapInPandas(run, "node binary, whole binary, n int, keys array<long>, bits array<long>")
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("whole", "n", "keys", "bits")])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar; texts: node, text, one row per node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler()
        last: dict[bytes, np.ndarray] = {}  # a is often the same for many pairs
        for whole in batches:
            kept = []
            for node, x, other, y in whole.itertuples(index=False):
                if node not in last:
                    last = {node: shingle(x)}
                if aligned(last[node], shingle(y)):
                    kept.append((node, other))
            yield pd.DataFrame(kept, columns=["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "x", "b", "y").mapInPandas(run, "a binary, b binary")


def near(n: Column, m: Column, x: Column, y: Column) -> Column:
    """Can nodes of n and m shingles with bitmaps x and y be similar? No pair that is similar fails."""
    most = F.floor((n + m) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9)
    unlike = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return (F.abs(n - m) <= most) & F.when(F.size(x) == F.size(y), unlike <= most).otherwise(True)


def opened(rows: DataFrame, outside: bool) -> DataFrame:
    """The rows of buckets with several classes, with main (is the node of the bucket's largest class? never, if not outside)
    and band (of lengths; similar nodes are at most one band apart). rows: key, node, n, bits, centre, class."""
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("members"))
    largest = sizes.groupBy("key").agg(F.max_by("class", F.struct("members", "class")).alias("main"), F.count("*").alias("classes"))
    several = largest.where("classes > 1").select("key", "main")
    band = F.floor(F.log("n") / F.log(F.lit(LENGTH_STEP))).cast("int")
    return rows.join(several, "key").withColumn("main", (F.col("class") == F.col("main")) & F.lit(outside)).withColumn("band", band)


def leaders(rows: DataFrame, count: int) -> DataFrame:
    """The first ``count`` nodes of each bucket that are not main, largest centre first. rows: as opened() gives them."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("centre"), "node"))
    lead = rows.where(~F.col("main")).withColumn("rank", rank).where(F.col("rank") <= count)
    return lead.select("key", *[F.col(c).alias(f"lead_{c}") for c in ("node", "n", "bits", "centre", "class", "band")])


def behind(centre: str, node: str) -> Column:
    return (F.col("centre") < F.col(centre)) | ((F.col("centre") == F.col(centre)) & (F.col("node") > F.col(node)))


def held_against(rows: DataFrame, lead: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that may be similar: each bucket's leaders with main nodes and those that rank behind them."""
    lead = lead.withColumn("band", F.explode(F.array(*[F.col("lead_band") + k for k in (-1, 0, 1)])))
    met = (F.col("main") | behind("lead_centre", "lead_node")) & (F.col("class") != F.col("lead_class"))
    met &= near(F.col("n"), F.col("lead_n"), F.col("bits"), F.col("lead_bits"))
    return rows.join(lead, ["key", "band"]).where(met).select(F.col("lead_node").alias("a"), F.col("node").alias("b")).distinct()


def unheld(rows: DataFrame, lead: DataFrame) -> DataFrame:
    """key, node of the rows that were not leaders."""
    end = lead.groupBy("key").agg(F.max(F.struct((-F.col("lead_centre")).alias("less"), "lead_node")).alias("end"))
    end = end.select("key", (-F.col("end.less")).alias("end_centre"), F.col("end.lead_node").alias("end_node"))
    return rows.join(end, "key").where(F.col("main") | behind("end_centre", "end_node")).select("key", "node")


def labels(docs: DataFrame) -> DataFrame:
    """node, label (the smallest node of its class) of the nodes that may be in a class with others; docs: text, node."""
    sketched = written(sketches(docs.select("node", "text")))
    one = sketched.groupBy("whole").agg(F.min_by(F.struct("node", "n", "keys", "bits"), "node").alias("first")).select("whole", "first.*")
    equal = sketched.select("whole", F.col("node").alias("also")).join(one.select("whole", "node"), "whole").where("also <> node").select("node", "also")
    posting = one.select("node", F.explode("keys").alias("key"))
    shared = posting.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bucket = written(posting.join(shared, "key"))
    centre = bucket.groupBy("node").agg(F.sum("size").alias("centre"))
    members = written(one.select("node", "n", "bits").join(centre, "node").withColumn("class", F.col("node")))
    texts = written(docs.select("node", "text").join(members.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    held, count = 0, 1
    while True:
        rows = written(opened(bucket.select("key", "node").join(members, "node").select("key", "node", "n", "bits", "centre", "class"), held >= SURE))
        if rows.isEmpty():
            discard(rows)
            break
        lead = written(leaders(rows, count))  # a table: the join with it is one between two exchanges, whose hot keys are split
        new = written(verified(held_against(rows, lead), texts))
        if not new.isEmpty():
            of = members.select("node", "class")
            ends = new.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            into = components(ends)
            merged = written(members.join(into.toDF("class", "into"), "class", "left").select("node", "n", "bits", "centre", F.coalesce("into", "class").alias("class")))
            discard(members, into)
            members = merged
        left = written(unheld(rows, lead))
        discard(new, lead, bucket, rows)
        bucket = left
        held += count
        count = held * (GROWTH - 1)
    discard(bucket, texts)
    label = members.select("node", F.col("class").alias("label"))
    also = equal.join(label, "node", "left").select(F.col("also").alias("node"), F.coalesce("label", "node").alias("label"))
    out = written(label.unionByName(also))
    discard(members, sketched)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) for every row of docs (doc_id, text)."""
    docs = nodes_of(docs)
    label = labels(docs)
    rows = docs.select("doc_id", "node").join(label, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class"))
    alone = rows.where("class is null").select("doc_id", F.col("doc_id").alias("class_id"))
    rows = rows.where("class is not null")
    first = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "class").select("doc_id", "class_id").unionByName(alone)


def dedup(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, one of each class: the smallest by doc_id (none is last), then by node; repeated rows once.

    Rows count, not their doc_id: unlike texts under one doc_id both stay, and copies without a doc_id go. A null text is
    alone, and once under its doc_id.
    """
    own = nodes_of(docs)
    rows = own.where("node is not null").join(labels(own), "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("class"))
    held = written(rows.groupBy("class", "doc_id", "node").agg(F.count("*").alias("n")))
    first = held.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    gone = written(held.join(first, "class").where(~kept).select(F.col("doc_id").alias("__doc"), F.col("node").alias("__gone")))
    noted = docs.withColumn("__node", F.unhex(F.md5("text")))
    left = noted.join(gone, noted["doc_id"].eqNullSafe(gone["__doc"]) & (noted["__node"] == gone["__gone"]), "left_anti")
    empty = docs.where("text is null").groupBy("doc_id").count().where("doc_id is not null and count > 1")
    if not (held.where("n > 1").isEmpty() and empty.isEmpty()):
        known = F.col("__node").isNotNull()
        alone = left.where(~known)
        left = left.where(known).dropDuplicates(["doc_id", "__node"]).unionByName(alone.where("doc_id is null")).unionByName(alone.where("doc_id is not null").dropDuplicates(["doc_id"]))
    return left.drop("__node")


def query(spark, sf_dir) -> DataFrame:
    return classes(table(spark, sf_dir, "documents", "doc_id", "text"))
