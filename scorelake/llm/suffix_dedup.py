"""Removal of long repeats: a distributed, common-prefix-aware merge sort of suffixes.

Every byte that lies in a string of LENGTH bytes which also starts anywhere else goes. Sorting all suffixes would move
each byte hundreds of times, so suffixes are sorted where repeats can be seen, without missing any:

1. Anchors. In each window of LENGTH bytes, the place with the smallest hashed 8-gram among the first SPAN + 1 places
   is its anchor. Equal windows have their anchors at the same distance, and share the anchor's next
   RIGHT = LENGTH - SPAN bytes.
2. Filter. An anchor whose next RIGHT bytes' fingerprint occurs once in the corpus has no repeated window. Equal
   fingerprints only make candidates; nothing is decided by them.
   Equal texts are one row throughout: every window of a text with copies is repeated.
3. Runs. Suffixes at candidate anchors (LENGTH bytes, and the SPAN bytes before them) are sorted where their document
   is, equal ones becoming one entry, and exchanged as front-coded runs, dealt by fingerprint range.
4. Merge. A loser tree merges a range's runs, reading no known prefix twice, and yields each suffix's common prefix
   with the one before it. A window that starts o bytes before its anchor is repeated exactly if another suffix has the
   same LENGTH - o bytes after, and the same o bytes before; both are read off the common prefixes of the two orders.
5. Each document gathers its repeated stretches, and is read once more to cut them out.

Defined cases: null and empty texts have no bytes and keep the empty text; documents shorter than LENGTH lose nothing;
texts of any length are treated whole; doc_id may be of any type; equal documents, whatever their doc_id, are repeats of each other; overlapping
repeats inside one document count; matches never cross documents. A passage that many different texts share is merged in
one part; its entries there differ where the texts around it do (its ends), and are one entry per run elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import suffix_merge
from .common import bound_batches, table, written

LENGTH = 200
SPAN = 128
#: Candidate anchors that are merged in one task, on average.
PART_ANCHORS = 1 << 16
#: Candidate anchors that a task sorts into one set of runs.
RUN_ANCHORS = 50_000
_PIECE = 1 << 19
_MASK = np.uint64((1 << 21) - 1)
_ODD = np.random.default_rng(4).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    return np.ndarray((n,), "<u8", data, 0, (1,))


def fingerprints(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Of data[a : a + size] for each a in at; size is a multiple of 8, data ends in 8 spare bytes."""
    g = _grams(data, len(data) - 8)
    h = np.zeros(len(at), np.uint64)
    for j in range(size // 8):
        h = _mix(h + g[at + 8 * j] * _ODD[j])
    return h


def anchors(texts: list[bytes], length: int = LENGTH, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, fingerprint of the next length - span bytes) of every anchor."""
    owners, places, prints = [], [], []
    group: list[tuple[int, int, bytes]] = []

    def work() -> None:
        data = np.frombuffer(b"".join(x for _, _, x in group) + bytes(8), np.uint8)
        sizes = np.array([len(x) for _, _, x in group])
        begin = np.cumsum(sizes) - sizes
        n = len(data) - 8
        h = (_mix(_grams(data, n)) & ~_MASK) | np.arange(n, dtype=np.uint64)
        s = 1
        while 2 * s <= span + 1:
            h = np.minimum(h[:-s], h[s:])
            s *= 2
        if s < span + 1:
            h = np.minimum(h[: s - span - 1], h[span + 1 - s :])
        count = sizes - length + 1  # windows of each text
        window = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        at = (h[window] & _MASK).astype(np.int64)
        at = at[np.concatenate([[True], np.diff(at) != 0])]
        who = np.searchsorted(begin, at, "right") - 1
        owners.append(np.array([g[0] for g in group])[who])
        places.append(at - begin[who] + np.array([g[1] for g in group])[who])
        prints.append(fingerprints(data, at, (length - span) // 8 * 8))
        group.clear()

    total = 0
    for k, text in enumerate(texts):
        for off in range(0, max(len(text) - length + 1, 0), _PIECE):  # windows that start in this piece
            x = text[off : off + _PIECE + length - 1]
            if total + len(x) > 2 * _PIECE - 8 and group or total > _PIECE // 2:
                work()
                total = 0
            group.append((k, off, x))
            total += len(x)
    if group:
        work()
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owners, places, prints = map(np.concatenate, (owners, places, prints))
    key = owners * (1 << 40) + places
    _, first = np.unique(key, return_index=True)  # a piece's end may find an anchor again
    return owners[first], places[first], prints[first]


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _by_node(node: np.ndarray, nodes: list[bytes], values: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """values (rows x k) as one binary of int32 per node."""
    order = np.argsort(node, kind="stable")
    node = node[order]
    cuts = np.flatnonzero(np.diff(node)) + 1
    values = np.ascontiguousarray(values[order].astype(np.int32))
    parts = np.split(values, cuts) if len(node) else []
    return [nodes[i] for i in (node[np.concatenate([[0], cuts])] if len(node) else [])], [p.tobytes() for p in parts]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """node, text, copies: one row per distinct text, so that a text with many copies is one row from here on."""
    node = F.unhex(F.md5("text")).alias("node")
    return docs.where("text is not null").groupBy(node).agg(F.first("text").alias("text"), F.count("*").alias("copies")).where("node is not null")


def candidates(texts: DataFrame, length: int, span: int) -> DataFrame:
    """node, places of anchors whose fingerprint occurs elsewhere. texts: node, text.

    Anchors go out as plain rows, dealt and sorted by fingerprint. Of a batch's equal fingerprints one goes there and
    tells that there are more; the others are dealt by themselves (kind 0) and kept unasked.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, place, fp = anchors([_encoded(t) for t in b.column("text").to_pylist()], length, span)
            if not len(owner):
                continue
            _, first, inverse, n = np.unique(fp, return_index=True, return_inverse=True, return_counts=True)
            kind = np.zeros(len(fp), np.int8)
            kind[first] = np.where(n > 1, 2, 1)
            key = np.where(kind > 0, fp, _mix(fp + place.astype(np.uint64) * _ODD[60] + owner.astype(np.uint64) * _ODD[61]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "kind": pa.array(kind), "node": b.column("node").take(pa.array(owner)), "place": pa.array(place.astype(np.int32))})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of their keys: those whose key is told more than once, and those kept unasked."""
        at, told, held = None, 0, None  # the last key, how often it was told so far, and its row if that is once
        for b in batches:
            key, kind = b.column("key").to_numpy(), b.column("kind").to_numpy().astype(np.int64)
            rows, keep = b.select(["node", "place"]), kind == 0
            asked = np.flatnonzero(kind)
            if len(asked):
                k = key[asked]
                begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                total = np.add.reduceat(kind[asked], begin)
                if k[0] == at:
                    total[0] += told
                    if held is not None and total[0] > 1:
                        yield held
                keep[asked] = np.repeat(total > 1, np.diff(np.append(begin, len(k))))
                at, told = k[-1], total[-1]
                held = rows.slice(int(asked[-1]), 1) if told == 1 else None
            yield rows.filter(pa.array(keep))

    told = texts.select("node", "text").mapInArrow(emit, "key long, kind byte, node binary, place int")
    return told.repartition("key").sortWithinPartitions("key").mapInArrow(decide, "node binary, place int").groupBy("node").agg(F.collect_list("place").alias("places"))


def stretches(found: DataFrame, parts: int, length: int, span: int) -> DataFrame:
    """node, spans (packed starts and ends) of repeated windows. found: node, text, copies, places."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: dict[int, dict[tuple[bytes, bytes], list[int]]] = {}
        nodes: list[bytes] = []
        held = 0

        def given() -> pd.DataFrame:
            nonlocal held
            rows = []
            table = np.frombuffer(b"".join(nodes), "V16") if nodes else np.zeros(0, "V16")
            for part, own in entries.items():
                keys = sorted(own)
                members = [np.array(own[k], np.int64).reshape(-1, 2) for k in keys]
                known, index = np.unique(np.concatenate(members)[:, 0], return_inverse=True)
                flat = np.concatenate(members)
                flat[:, 0] = index
                sizes = [len(m) for m in members]
                rows.append((part, suffix_merge.pack([k[0] for k in keys], [k[1] for k in keys], np.split(flat.astype(np.uint32), np.cumsum(sizes)[:-1]), table[known])))
            entries.clear()
            nodes.clear()
            held = 0
            return pd.DataFrame(rows, columns=["part", "run"])

        for b in batches:
            for node, text, places in zip(b["node"], b["text"], b["places"], strict=True):
                data = _encoded(text)
                at = np.unique(np.asarray(places)).astype(np.int64)
                padded = np.frombuffer(data + bytes(8), np.uint8)
                part = (fingerprints(padded, at, (length - span) // 8 * 8) >> np.uint64(32)).astype(np.int64) * parts >> 32
                for a, p in zip(at.tolist(), part.tolist(), strict=True):
                    entries.setdefault(p, {}).setdefault((data[a : a + length], data[max(0, a - span) : a][::-1]), []).extend((len(nodes), a))
                nodes.append(node)
                held += len(at)
                if held > RUN_ANCHORS:
                    yield given()
        if held:
            yield given()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [suffix_merge.unpack(x) for x in pdf["run"]]
        order, lcp = suffix_merge.merge([(g[0], g[1]) for g in got])
        n = len(order)
        offset = np.cumsum([0] + [len(g[0]) for g in got])
        place = np.array([offset[r] + i for r, i in order])
        lefts = [got[r][2][i] for r, i in order]
        size = np.array([len(got[r][0][i]) for r, i in order])
        members = np.concatenate([g[3] for g in got])[place]  # how many have each entry
        before, width = _common_left(lefts, span)
        low, high = repeated(np.array(lcp), size, before, width, members, length, span)
        # back to members: (node, anchor) of each entry
        first = np.cumsum(members_of := np.concatenate([g[3] for g in got])) - members_of
        table = np.concatenate([g[5] for g in got])
        node_offset = np.cumsum([0] + [len(g[5]) for g in got])
        flat = np.concatenate([g[4].astype(np.int64) + [o, 0] for g, o in zip(got, node_offset, strict=False)])
        hit = np.flatnonzero(high >= 0)
        take = np.repeat(first[place[hit]], members[hit]) + _ranges(members[hit])
        anchor, who = flat[take, 1], flat[take, 0]
        starts, ends = anchor - np.repeat(high[hit], members[hit]), anchor + length - np.repeat(low[hit], members[hit])
        known, who = np.unique(table[who], return_inverse=True) if len(who) else (table[:0], who)
        names, spans = _by_node(who, [x.tobytes() for x in known], np.stack([starts, ends], axis=1) if len(who) else np.zeros((0, 2), np.int64))
        return pd.DataFrame({"node": names, "spans": spans}) if n else pd.DataFrame({"node": [], "spans": []})

    pieces = found.mapInPandas(runs, "part int, run binary").groupBy("part").applyInPandas(merged, "node binary, spans binary")
    return pieces.groupBy("node").agg(F.collect_list("spans").alias("spans"))


def _ranges(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _common_left(lefts: list[bytes], span: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Order of the bytes before the anchors, read backwards, and each one's common prefix with the one before it."""
    order = np.array(sorted(range(len(lefts)), key=lefts.__getitem__), np.int64)
    width = np.array([len(x) for x in lefts], np.int64)
    lcp = np.zeros(len(lefts), np.int64)
    for at in range(1, len(lefts), 50_000):
        part = order[at - 1 : at + 50_000]
        m = np.frombuffer(b"".join([lefts[i].ljust(span, b"\0") for i in part]), np.uint8).reshape(-1, span)
        differ = m[1:] != m[:-1]
        lcp[at : at + len(part) - 1] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), span), np.minimum(width[part[1:]], width[part[:-1]]))
    return (order, lcp), width


def repeated(lcp: np.ndarray, size: np.ndarray, before: tuple[np.ndarray, np.ndarray], width: np.ndarray, members: np.ndarray, length: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, in merged order, the least and most bytes o before its anchor at which a repeated window starts.

    Entries agree on a window if they agree on length - o bytes after the anchor (a stretch of the merged order between
    smaller common prefixes) and on o bytes before it (likewise in the order of what stands before).
    """
    n = len(lcp)
    low, high = np.full(n, length), np.full(n, -1)
    order, left = before
    # Only entries that share length - span bytes with another, or that more than one has, can be repeated.
    near = np.maximum(lcp, np.append(lcp[1:], 0)) >= length - span if n else np.zeros(0, bool)
    live = near | (members > 1)
    for o in range(span + 1):
        fits = live & (size >= length - o) & (width >= o)
        if not fits.any():
            continue
        after = np.cumsum(lcp < length - o)
        prior = np.empty(n, np.int64)
        prior[order] = np.cumsum(left < o)
        at = np.flatnonzero(fits)
        key = after[at] * (n + 1) + prior[at]
        _, inverse = np.unique(key, return_inverse=True)
        hit = at[np.bincount(inverse, members[at])[inverse] > 1]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


def _joined(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a union of spans (rows of start, end)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > far[:-1]])
    begin = np.flatnonzero(new)
    return list(zip(spans[begin, 0].tolist(), far[np.append(begin[1:] - 1, len(spans) - 1)].tolist(), strict=True))


def _cut(text: str | None, copies, spans, length: int) -> tuple[int, int, int, bytes]:
    """bytes, removed bytes, removed runs, and what is left. Every window of a text with copies is repeated."""
    data = _encoded(text)
    if copies > 1 and len(data) >= length:
        return len(data), len(data), 1, b""
    if spans is None or not len(spans):
        return len(data), 0, 0, data
    runs = _joined(np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2).astype(np.int64))
    kept, at = [], 0
    for a, e in runs:
        kept.append(data[at:a])
        at = e
    kept.append(data[at:])
    return len(data), sum(e - a for a, e in runs), len(runs), b"".join(kept)


def repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, part_anchors: int = PART_ANCHORS) -> DataFrame:
    """node, text, copies and spans (packed, may be null), the repeated stretches, of each distinct text of docs."""
    bound_batches(docs.sparkSession)
    texts = distinct_texts(docs)
    found = written(candidates(texts, length, span))
    total = found.agg(F.sum(F.size("places"))).first()[0] or 0
    parts = max(1, -(-total // part_anchors))
    # Both joins read one shuffle of the texts by node: the same columns, dealt by the same key.
    return texts.join(stretches(texts.join(found, "node"), parts, length, span), "node", "left")


def digest(docs: DataFrame, length: int = LENGTH, span: int = SPAN, part_anchors: int = PART_ANCHORS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(n, gone, k, hashlib.sha256(kept).hexdigest()) for n, gone, k, kept in map(partial(_cut, length=length), b["text"], b["copies"], b["spans"])]
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).assign(node=b["node"].to_numpy())[["node", "n_bytes", "n_removed", "n_spans", "kept_sha256"]]

    each = repeats(docs, length, span, part_anchors).mapInPandas(run, "node binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("node")).join(each, "node", "left")
    none = {"n_bytes": 0, "n_removed": 0, "n_spans": 0, "kept_sha256": hashlib.sha256(b"").hexdigest()}
    return rows.select("doc_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in none.items()])


def remove(docs: DataFrame, length: int = LENGTH, span: int = SPAN, part_anchors: int = PART_ANCHORS) -> DataFrame:
    """docs, all columns, with the repeated stretches cut out of text; n_chars, if there, is counted anew.

    Stretches are byte ranges: a character of which a byte goes, goes whole. Null texts stay null.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, copies: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, c, s, length)[3].decode("utf-8", "ignore") for t, c, s in zip(text, copies, spans, strict=True)], dtype=object)

    each = repeats(docs, length, span, part_anchors)
    same = F.col("spans").isNull() & (F.col("copies") == 1)
    each = each.select(F.col("node").alias("__node"), F.when(same, F.col("text")).otherwise(cut("text", "copies", "spans")).alias("__left"))
    keyed = docs.withColumn("__node", F.unhex(F.md5("text"))).drop("text")
    out = keyed.join(each, "__node", "left").withColumn("text", F.col("__left"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def query(spark, sf_dir) -> DataFrame:
    return digest(table(spark, sf_dir, "documents", "doc_id", "text"))
