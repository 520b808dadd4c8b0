"""Removal of repeated word windows: super-k-mers, dealt by minimiser, whose windows are sorted and counted exactly.

Words are maximal runs without ASCII white space, unchanged. A window is WINDOW consecutive words of one document; a word
goes if a window that covers it also starts earlier: in a document before this one, or before here in this one.

1. Super-k-mers. The minimiser of a window is the smallest hash of its runs of GRAM words. Consecutive windows with one
   minimiser are one super-k-mer. Equal windows have equal minimisers, whatever stands around them.
2. Filter. A minimiser that stands once in the whole corpus is that of no repeated window.
   Of a batch's super-k-mers with one minimiser one row goes to be asked, with their number; the others stay where they are.
3. Buckets. Each remaining super-k-mer travels as one packed string to its minimiser's bucket, in document order; there
   equal strings and then the windows of unlike ones are sorted, and all but the first of equal windows are repeats.
   A minimiser of more than HOT super-k-mers (a line that very many documents share) has its windows dealt one by one, by
   their own hash, and the equal ones of a batch as one; so no bucket grows with the number of documents.
4. Each document gathers its repeated stretches, and is read once more to cut them out.

Hashes choose what meets where; what is equal is decided on the words themselves.

Defined cases: null and empty texts have no words; documents of fewer than WINDOW words lose nothing; texts of any length
are treated whole. Documents come in the order of doc_id, those without one last; unlike texts under one doc_id come in the
order of their md5; rows that repeat doc_id and text are one document, with one result. A text that stands under several
doc_ids is kept under the first and loses every window elsewhere. doc_id may be of any type that can be ordered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, discard, table, written
from .pieces import Memo

WINDOW = 20
GRAM = 5
#: Super-k-mers of one minimiser that one task sorts; the windows of more are dealt by themselves.
HOT = 4096
#: The longest super-k-mer, in windows; a longer one (a word repeated over and over) travels in parts.
LONGEST = 512
_ODD = np.random.default_rng(11).integers(1, 1 << 62, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Minimisers:
    """Words to super-k-mers, in text order: (minimiser, first window, end of windows, times its minimiser stands in it) of each."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram, self.memo = window, min(gram, window), Memo(xxhash.xxh64_intdigest, 1 << 17)

    def __call__(self, w: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(w) - self.window + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 4
        h = np.fromiter(map(self.memo.__getitem__, w), np.uint64, len(w))
        g = np.zeros(len(h) - self.gram + 1, np.uint64)
        for j in range(self.gram):
            g = _mix(g + h[j : j + len(g)] * _ODD[j])
        grams = g
        width, s = self.window - self.gram + 1, 1
        while 2 * s <= width:
            g = np.minimum(g[:-s], g[s:])
            s *= 2
        if s < width:
            g = np.minimum(g[: s - width], g[width - s :])
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        end = np.append(begin[1:], n)
        if (end - begin > LONGEST).any():
            parts = -(-(end - begin) // LONGEST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            begin, last = np.repeat(begin, parts) + nth * LONGEST, np.repeat(end, parts)
            end = np.minimum(begin + LONGEST, last)
        size = end - begin + width - 1  # runs of words in each
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(begin, size)
        times = np.add.reduceat(grams[place] == np.repeat(g[begin], size), first, dtype=np.int64)
        return g[begin].view(np.int64), begin, end, times


def distinct_texts(docs: DataFrame) -> DataFrame:
    """node, text, first (the smallest doc_id), at: one row per distinct text. at stands for the node where a clash only adds work."""
    node = F.unhex(F.md5("text")).alias("node")
    rows = docs.where("text is not null").groupBy(node).agg(F.first("text").alias("text"), F.min("doc_id").alias("first"))
    return rows.where("node is not null").withColumn("at", F.xxhash64("node"))


def candidates(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """key, at, begin, n of the super-k-mers that may hold repeats; n is the number with this key, null where another row of its key has it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Minimisers(window, gram)
        for b in batches:
            found = [split(words(t)) for t in b.column("text").to_pylist()]
            own = np.concatenate([f[0] for f in found])
            begin = np.concatenate([f[1] for f in found])
            times = np.concatenate([f[3] for f in found])
            at = np.repeat(b.column("at").to_numpy(), [len(f[0]) for f in found])
            _, first, inverse, n = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
            n = n + (np.bincount(inverse, times > 1, len(n)) > 0)  # a window can repeat inside a super-k-mer that has its minimiser twice
            count = np.zeros(len(own), np.int32)
            count[first] = n
            asked = count > 0
            dealt = np.where(asked, own.view(np.uint64), _mix(own.view(np.uint64) + at.view(np.uint64) + begin.astype(np.uint64) * _ODD[20]))
            yield pa.RecordBatch.from_pydict({"dealt": pa.array(dealt.view(np.int64)), "key": pa.array(own), "n": pa.array(count), "at": pa.array(at), "begin": pa.array(begin.astype(np.int32))})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by dealt, then n falling. Of each key the rows are held until their sum is known or past HOT."""
        held: list[pa.RecordBatch] = []
        last, total = None, 0

        def given() -> Iterator[pa.RecordBatch]:
            for r in held if total > 1 else []:
                yield r.append_column("n", pa.array(np.full(r.num_rows, total), pa.int32()))
            held.clear()

        for b in batches:
            dealt, n = b.column("dealt").to_numpy(), b.column("n").to_numpy().astype(np.int64)
            rows = b.select(["key", "at", "begin"])
            alone = n == 0
            if alone.any():
                free = rows.filter(pa.array(alone))
                yield free.append_column("n", pa.nulls(free.num_rows, pa.int32()))
            asked = np.flatnonzero(~alone)
            if not len(asked):
                continue
            key, rows, n = dealt[asked], rows.take(pa.array(asked)), n[asked]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sums = np.add.reduceat(n, begin)
            end = np.append(begin[1:], len(key))
            if key[0] == last:
                total = min(total + int(sums[0]), HOT + 1)
                held.append(rows.slice(0, int(end[0])))
                if total > HOT:
                    yield from given()
                begin, end, sums = begin[1:], end[1:], sums[1:]
            if not len(begin):
                continue
            yield from given()
            inner = (sums > 1) & (np.arange(len(sums)) < len(sums) - 1)  # keys that end in this batch
            size = end - begin
            keep = np.zeros(len(key), bool)
            keep[begin[0] :] = np.repeat(inner, size)
            whole = rows.filter(pa.array(keep))
            yield whole.append_column("n", pa.array(np.minimum(np.repeat(sums[inner], size[inner]), HOT + 1), pa.int32()))
            held.append(rows.slice(int(begin[-1])))
            last, total = key[-1], min(int(sums[-1]), HOT + 1)
        yield from given()

    told = texts.select("at", "text").mapInArrow(emit, "dealt long, key long, n int, at long, begin int")
    return told.repartition("dealt").sortWithinPartitions("dealt").mapInArrow(decide, "key long, at long, begin int, n int")


def _runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal runs of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)


def _later(value):
    """A place in the order of documents: those without doc_id last."""
    first, node, begin = value
    return first is None, first if first is not None else 0, node, begin


def packed(texts: DataFrame, hot: DataFrame, found: DataFrame, window: int, gram: int) -> DataFrame:
    """bucket, first, node, begin, body: super-k-mers on their way; body null: windows already known to be repeats, from begin to end."""
    flagged = found.join(hot.select("key", F.lit(True).alias("hot")), "key", "left")
    own = flagged.groupBy("at").agg(F.collect_list(F.struct("begin", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("found"))
    rows = texts.join(own, "at").select("node", "first", "text", "found")
    first_type = texts.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = Minimisers(window, gram)
        for b in batches:
            out: list[tuple] = []
            seen: dict[bytes, tuple] = {}  # windows of hot keys, and where each is first
            for node, first, text, found in zip(b["node"], b["first"], b["text"], b["found"], strict=True):
                first = None if first is None or first != first else first
                w = words(text)
                asked = {f["begin"]: f["hot"] for f in found}
                for key, a, e, _ in zip(*(x.tolist() for x in split(w)), strict=True):
                    if a not in asked:
                        continue
                    if not asked[a]:
                        out.append((key, first, node, a, e, b" ".join(w[a : e + window - 1])))
                        continue
                    for i in range(a, e):
                        body, here = b" ".join(w[i : i + window]), (first, node, i)
                        there = seen.get(body)
                        if there is None or _later(here) < _later(there):
                            seen[body], here = here, there
                        if here is not None:
                            out.append((xxhash.xxh64_intdigest(here[1], here[2]) - (1 << 63), here[0], here[1], here[2], here[2] + 1, None))
            out += [(xxhash.xxh64_intdigest(body) - (1 << 63), *at, at[2] + 1, body) for body, at in seen.items()]
            for at in range(0, len(out), 4096):
                yield pd.DataFrame(out[at : at + 4096], columns=["bucket", "first", "node", "begin", "end", "body"]).astype({"first": object})

    return rows.mapInPandas(run, f"bucket long, first {first_type}, node binary, begin int, end int, body binary")


def repeated(rows: list[tuple[bytes, int, int, bytes]], window: int) -> Iterator[tuple[bytes, int, int]]:
    """(node, begin, end) of the repeated windows of one bucket. rows: node, begin, end, body, in document order."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][3])
    windows: list[tuple[bytes, int, int]] = []
    marks = [np.zeros(e - a, bool) for _, a, e, _ in rows]
    for _, equal in groupby(order, key=lambda i: rows[i][3]):
        first, *others = equal  # the sort is stable, so the first in document order
        for i in others:
            marks[i][:] = True
        w = rows[first][3].split()
        windows += [(b" ".join(w[j : j + window]), first, j) for j in range(len(marks[first]))]
    windows.sort()
    for (x, _, _), (y, i, j) in pairwise(windows):
        if x == y:
            marks[i][j] = True
    for (node, a, _, _), mark in zip(rows, marks, strict=True):
        if mark.any():
            for s, e in _runs(mark):
                yield node, a + s, a + e


def stretches(dealt: DataFrame, window: int) -> DataFrame:
    """node, spans (begin and end of stretches of repeated windows) of every text that has some. dealt: as packed() gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, bytes]] = []
        last = None

        def told(found) -> pa.RecordBatch:
            node, a, e = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_pydict({"node": pa.array(node, pa.binary()), "a": pa.array(a, pa.int32()), "e": pa.array(e, pa.int32())})

        for b in batches:
            found: list[tuple[bytes, int, int]] = []
            for bucket, node, a, e, body in zip(*(b.column(c).to_pylist() for c in ("bucket", "node", "begin", "end", "body")), strict=True):
                if body is None:
                    found.append((node, a, e))
                    continue
                if bucket != last:
                    found += repeated(held, window)
                    held, last = [], bucket
                held.append((node, a, e, body))
            yield told(found)
        yield told(list(repeated(held, window)))

    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_last("first"), "node", "begin").select("bucket", "node", "begin", "end", "body")
    return ordered.mapInArrow(run, "node binary, a int, e int").groupBy("node").agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """node, text, first, at and spans (stretches of repeated windows, may be null) of each distinct text of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    texts = distinct_texts(docs)
    found = written(candidates(texts, window, gram))
    hot = written(found.where(F.col("n") > HOT).select("key").distinct())
    dealt = written(packed(texts, hot, found, window, gram))
    discard(found, hot)
    return texts.join(stretches(dealt, window), "node", "left")


def kept_words(text: str | None, spans, window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    w = words(text)
    if spans is None or not len(spans):
        return w, len(w)
    gone = np.zeros(len(w) + 1, np.int32)
    np.add.at(gone, [s["a"] for s in spans], 1)
    np.add.at(gone, [s["e"] + window - 1 for s in spans], -1)
    return [w[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()], len(w)


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text)."""
    shape = "n_words long, n_removed long, kept_sha256 string, copy_removed long, copy_sha256 string"
    names = [c.split()[0] for c in shape.split(", ")]
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kept, n in map(partial(kept_words, window=window), b["text"], b["spans"]):
                own = hashlib.sha256(b" ".join(kept)).hexdigest()
                out.append((n, n - len(kept), own, n if n >= window else 0, none if n >= window else own))
            yield pd.DataFrame(out, columns=names).assign(node=b["node"].to_numpy(), first=b["first"].to_numpy())[["node", "first", *names]]

    each = repeats(docs, window, gram)
    each = each.select("node", "first", "text", "spans").mapInPandas(run, f"node binary, first {each.schema['first'].dataType.simpleString()}, {shape}")
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("node")).join(each, "node", "left")
    is_first = F.col("doc_id").eqNullSafe(F.col("first"))
    return rows.select(
        "doc_id",
        F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.coalesce(F.when(is_first, F.col("n_removed")).otherwise(F.col("copy_removed")), F.lit(0)).alias("n_removed"),
        F.coalesce(F.when(is_first, F.col("kept_sha256")).otherwise(F.col("copy_sha256")), F.lit(none)).alias("kept_sha256"),
    )


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id and text, the words that stay joined by one space, of every row of docs; a null text stays null."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(kept_words(t, s, window)[0]).decode("utf-8", "surrogatepass") for t, s in zip(text, spans, strict=True)], dtype=object)

    each = repeats(docs, window, gram).select("node", "first", cut("text", F.col("spans")).alias("left"), F.size(F.split(F.trim("text"), r"[\x20\x09-\x0D]+")).alias("many"))
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("node")).join(each, "node", "left")
    own = F.col("doc_id").eqNullSafe(F.col("first")) | (F.col("many") < window)
    return rows.select("doc_id", F.when(own, F.col("left")).when(F.col("node").isNotNull(), F.lit("")).alias("text"))


def query(spark, sf_dir) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
v AS (SELECT doc_id, a, list_aggregate(list_slice(w, a, a + 19), 'string_agg', ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS a FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, a FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY s ORDER BY doc_id, a) AS k FROM v) WHERE k > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(a, a + 20)) AS p FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
