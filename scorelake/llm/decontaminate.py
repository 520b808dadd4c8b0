"""Benchmark decontamination by a prefix-filtered containment join over item-sized windows.

Every run of ``window`` consecutive item words is a shingle; an item of fewer words is one shingle. A shingle counts
as contained only whole (containment 1), so by the prefix-filter bound one token is a sufficient prefix: its rarest
word, by document frequency over all documents (ties to the smaller word). Documents are joined on those prefix
tokens; the token's place in the shingle fixes where the shingle must start (positional bound), the shingle must fit
in the document (length bound), and the words there are compared with the shingle itself (verification).

Defined cases: null or word-less texts have no words, hit nothing and are hit by nothing; items with a null id can
mark words but are not counted or named; repeated document rows are judged row by row; repeated item ids count once;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, table, words

#: Bytes of item texts that one broadcast index may hold; larger benchmarks are joined block by block.
INDEX_BYTES = 16 << 20
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
PARTIAL = "doc_id long, digest string, n_words long, starts array<int>, ends array<int>, items array<string>"


def shingles(text: str | None, window: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()


class Index:
    """Shingles by prefix token, and the items that have each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, frequency: dict[bytes, int]):
        self.by_token: dict[bytes, set[tuple[int, int]]] = defaultdict(set)  # token -> (place in the shingle, length)
        self.shingles: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item_id, text in items:
            for s in shingles(text, window):
                self.shingles[s].add(item_id)
        for s in self.shingles:
            token = min(s, key=lambda t: (frequency.get(t, 0), t))
            self.by_token[token].add((s.index(token), len(s)))
        self.tokens = frozenset(self.by_token)

    def matches(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where shingles occur in w, and ids of the items that have them."""
        found, ids = [], set()
        if self.tokens.isdisjoint(w):
            return found, ids
        for i, token in enumerate(w):
            for place, n in self.by_token.get(token, ()):
                if 0 <= (start := i - place) and start + n <= len(w) and (of := self.shingles.get(tuple(w[start : start + n]))):
                    found.append((start, start + n))
                    ids |= of
        return found, ids - {None}


def digest(n_words: int, spans: list[tuple[int, int]], ids: set[str]) -> tuple:
    hit = bytearray(n_words)
    for a, b in spans:
        hit[a:b] = b"\1" * (b - a)
    n_hit = hit.count(1)
    return n_words, n_hit, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n_hit > 0


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Document frequency over all documents of the words of a bounded vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                total.update(known.value.intersection(words(text)))
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    rows = docs.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def indexes(docs: DataFrame, benchmark: DataFrame, window: int, index_bytes: int) -> list:
    """Broadcast indexes of the benchmark's blocks, one if its texts take at most index_bytes. Each is made when asked for."""
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // index_bytes) or 1

    def index(block: int):
        rows = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        kept = [(r[0], r[1]) for r in rows.collect()]  # bounded by index_bytes
        vocabulary = frozenset(t for _, text in kept for t in words(text))
        return sc.broadcast(Index(kept, window, frequencies(docs, vocabulary) if vocabulary else {}))

    return [lambda block=block: index(block) for block in range(blocks)]


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, words, hit words, items with occurring windows and their digest, for every row of docs (doc_id, text).

    benchmark: item_id, text. It is indexed whole if its texts take at most index_bytes, a size checked first; else in
    that many blocks of bounded size, each held against all documents, and the blocks' findings are merged by document.
    """
    docs = docs.select("doc_id", "text")
    blocks = indexes(docs, benchmark, window, index_bytes)
    if len(blocks) == 1:
        held = blocks[0]()

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for text in b["text"]:
                    w = words(text)
                    out.append(digest(len(w), *held.value.matches(w)))
                yield pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]).assign(doc_id=b["doc_id"].to_numpy())[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]]

        return docs.mapInPandas(judge, OUT)

    def partial(index) -> DataFrame:
        held = index()

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                    w = words(text)
                    spans, ids = held.value.matches(w)
                    if spans:
                        out.append((doc_id, hashlib.sha256(text.encode()).hexdigest(), len(w), [a for a, _ in spans], [e for _, e in spans], sorted(ids)))
                yield pd.DataFrame(out, columns=["doc_id", "digest", "n_words", "starts", "ends", "items"])

        return docs.distinct().mapInPandas(judge, PARTIAL)

    found = partial(blocks[0])
    for block in blocks[1:]:
        found = found.unionByName(partial(block))
    found = found.groupBy("doc_id", "digest").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    base = docs.withColumn("digest", F.sha2("text", 256)).alias("d")
    joined = base.join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.digest") == F.col("f.digest")), "left").select("d.doc_id", "d.text", "f.starts", "f.ends", "f.items")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                none = r.starts is None
                out.append((r.doc_id, *digest(len(words(r.text)), [] if none else list(zip(r.starts, r.ends, strict=True)), set() if none else set(r.items))))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return joined.mapInPandas(merge, OUT)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Rows of docs, all columns, in which no shingle occurs; word-less and null texts stay."""

    def without(held):
        @F.pandas_udf("boolean")
        def free(texts: pd.Series) -> pd.Series:
            return pd.Series([not held.value.matches(words(t))[0] for t in texts], dtype=bool)

        return free("text")

    out = docs
    for index in indexes(docs, benchmark, window, index_bytes):
        out = out.where(without(index()))
    return out


def query(spark, sf_dir) -> DataFrame:
    return find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, n, list_aggregate(list_slice(w, a, a + n - 1), 'string_agg', ' ') AS s
      FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, n, a, list_aggregate(list_slice(w, a, a + n - 1), 'string_agg', ' ') AS s
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n)),
m AS (SELECT doc_id, g.n, a, item_id FROM g JOIN s ON g.s = s.s AND g.n = s.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM m) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)
"""
