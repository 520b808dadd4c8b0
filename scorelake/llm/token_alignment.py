"""Alignment of two tokenizers: which ids of one stand where which ids of the other stand, over the whole corpus.

Each text is encoded by a byte-level BPE (A) and a piece BPE (B). Both sides' tokens are intervals of the bytes of space +
text. Places where tokens of both end cut them into groups; all pairs of an A and a B token of a group are linked.

1. Inside an Arrow batch DuckDB holds two tables of intervals, the texts one behind the other. An ASOF join gives each A
   token the B token that reaches its end; where the ends are equal a group ends, and a window sum numbers the groups. A
   second ASOF join gives each B token the group whose range it lies in, and a join of both sides by group gives the links.
   A document's distinct linked pairs go on with their numbers of links, and the batch's pairs with their documents.
2. Spark sums the batches' counts: how many documents hold a pair.
3. Counts come back to the documents in blocks of BLOCK pairs, a bounded broadcast each; one block holds all pairs there are
   until the corpus has more than that, and each further one is one more pass over the documents' pairs, not over texts.

Defined cases: a text that is null, empty, or that either side's tokens do not give back byte for byte (a literal U+2581,
say) has no tokens: zeros and an empty groups_sha256; strings of special tokens are plain text; texts of any length are encoded
whole; repeated rows are documents each; an empty table gives no rows; doc_id may be of any type and null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bound_batches, discard, table, written
from .pieces import MARK

BYTE_MODEL, PIECE_MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Pairs and counts that one broadcast holds, 16 bytes each.
BLOCK = 1 << 22
#: Bytes of text that DuckDB holds at a time; a longer text is held alone.
PIECE = 1 << 20
OUT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: The low bits of a pair's key hold B's id.
B_BITS = 15


def byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes with: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteSide:
    def __init__(self, model: str = BYTE_MODEL):
        import tiktoken

        with open(model, encoding="utf-8") as f:
            whole = json.load(f)
        letters = byte_letters()
        special = {t["id"] for t in whole["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in whole["model"]["vocab"].items() if i not in special}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.texts = [b""] * (1 + max(whole["model"]["vocab"].values()))
        for text, i in ranks.items():
            self.texts[i] = text

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]


class PieceSide:
    def __init__(self, model: str = PIECE_MODEL):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        if len(names) > 1 << B_BITS:
            raise ValueError(f"more than {1 << B_BITS} pieces")
        self.texts = [bytes([int(x[1:-1], 16)]) if p.is_byte(i) else b"" if p.is_control(i) or p.is_unknown(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the side itself puts a space before it."""
        return self.processor.encode(texts, num_threads=1) if texts else []


SETUP = ["SET threads = 1", "SET memory_limit = '600MB'", "SET temp_directory = ''", "SET preserve_insertion_order = false"]
#: a, b: pos, doc, id, s, e (an interval of bytes, over all texts of the piece).
GROUPS = """
CREATE OR REPLACE TEMP TABLE ga AS
SELECT a.pos, a.doc, a.id, a.s, a.e, a.e = b.e AS cut, coalesce(sum(CAST(a.e = b.e AS INT)) OVER (ORDER BY a.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
FROM a ASOF JOIN b ON a.e <= b.e;
CREATE OR REPLACE TEMP TABLE gb AS
SELECT b.pos, b.id, b.s, b.e, c.g FROM b ASOF JOIN (SELECT e, g FROM ga WHERE cut) c ON b.e <= c.e;
"""
#: A group is the range between two cuts; its tokens of A and of B are linked, each with each.
LINKS = """
CREATE OR REPLACE TEMP TABLE link AS SELECT ga.doc, (CAST(ga.id AS INT) << 15) + gb.id AS key FROM ga JOIN gb ON ga.g = gb.g;
"""
PAIRS = "SELECT doc, key, CAST(count(*) AS INT) AS n FROM link GROUP BY doc, key ORDER BY doc, key"


class Aligner:
    """Numbers and digests of documents, and their linked pairs, by DuckDB."""

    def __init__(self, a: ByteSide, b: PieceSide):
        import duckdb

        self.sides = (a, b)
        self.lengths = [np.array([len(x) for x in side.texts], np.int64) for side in self.sides]
        numbers = [str(i) for i in range(max(len(a.texts), len(b.texts)))]
        self.names = np.array([[f"{mark}{n}" for n in numbers] for mark in (",", "|", ";")], object)
        self.db = duckdb.connect(":memory:")
        for line in SETUP:
            self.db.execute(line)

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides of each text; none where either side does not give the text back."""
        asked = [k for k, t in enumerate(texts) if t]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        one = self.sides[0].encode([f" {texts[k]}" for k in asked])
        two = self.sides[1].encode([texts[k] for k in asked])
        for k, x, y in zip(asked, one, two, strict=True):
            whole = b" " + texts[k].encode("utf-8", "surrogatepass")
            if all(b"".join(map(side.texts.__getitem__, ids)) == whole for side, ids in zip(self.sides, (x, y), strict=True)):
                out[k] = (x, y)
        return out

    def intervals(self, ids: list[list[int]], side: int) -> pa.Table:
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, len(doc))
        e = np.cumsum(self.lengths[side][flat])
        own = {"pos": np.arange(len(doc)), "doc": doc, "id": flat, "s": e - self.lengths[side][flat], "e": e}
        return pa.table({k: pa.array(v.astype(np.int32)) for k, v in own.items()})

    def written_groups(self, ga, gb, n: int) -> list[str]:
        """Each document's groups as text: ids of A, a bar, ids of B, and so on."""
        g = np.concatenate([ga["g"], gb["g"]]).astype(np.int64)
        side = np.concatenate([np.zeros(len(ga["g"]), np.int64), np.ones(len(gb["g"]), np.int64)])
        ids = np.concatenate([ga["id"], gb["id"]])
        order = np.argsort(2 * g + side, kind="stable")
        g, side, ids = g[order], side[order], ids[order]
        mark = np.zeros(len(g), np.int64)
        mark[1:] = np.where(g[1:] != g[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        mark[:1] = 2
        doc_of = np.zeros(int(g[-1]) + 1 if len(g) else 0, np.int64)
        doc_of[ga["g"].astype(np.int64)] = ga["doc"]
        ends = np.searchsorted(doc_of[g], np.arange(n), "right") if len(g) else np.zeros(n, np.int64)
        parts = self.names[mark, ids].tolist()
        return ["".join(parts[a:e])[1:] for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray]]:
        """OUT of each text, its distinct linked pairs, and how many links each has."""
        ids = self.tokens(texts)
        n = len(texts)
        if not any(x for x, _ in ids):
            none = np.zeros(0, np.int32)
            return [(0, 0, 0, 0, "")] * n, [none] * n, [none] * n
        for name, side in (("a", 0), ("b", 1)):
            self.db.register(name, self.intervals([x[side] for x in ids], side))
        self.db.execute(GROUPS)
        ga = self.db.execute("SELECT doc, id, g FROM ga ORDER BY pos").fetchnumpy()
        gb = self.db.execute("SELECT id, g FROM gb ORDER BY pos").fetchnumpy()
        self.db.execute(LINKS)
        pairs = self.db.execute(PAIRS).fetchnumpy()
        groups = self.db.execute("SELECT doc, count(*) AS n FROM ga WHERE cut GROUP BY doc").fetchnumpy()
        n_groups = np.zeros(n, np.int64)
        n_groups[groups["doc"]] = groups["n"]
        cuts = np.searchsorted(pairs["doc"], np.arange(1, n))
        keys, counts = np.split(pairs["key"].astype(np.int32), cuts), np.split(pairs["n"], cuts)
        texts_of = self.written_groups(ga, gb, n)
        rows = [(len(x), len(y), int(k), int(c.sum()), hashlib.sha256(t.encode()).hexdigest() if x else "") for (x, y), k, c, t in zip(ids, n_groups, counts, texts_of, strict=True)]
        return rows, keys, counts


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about PIECE characters."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        if total and total + len(t or "") > PIECE:
            yield begin, k
            begin, total = k, 0
        total += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, values))], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)))


def aligned(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL) -> DataFrame:
    """A row for each row of docs (doc_id, text), with OUT, keys (its distinct linked pairs) and links (of each); and, with
    partial true, one for each piece of a batch, with the pairs of its documents in keys and in links how many documents have each."""
    bound_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, partial boolean, {OUT}, keys array<int>, links array<int>"
    names = [c.split()[0] for c in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = None
        for b in batches:
            align = align or Aligner(ByteSide(byte_model), PieceSide(piece_model))
            texts = b.column("text").to_pylist()
            for begin, end in _slices(texts):
                rows, keys, links = align(texts[begin:end])
                held, n = np.unique(np.concatenate(keys), return_counts=True)
                for part, of, k, m in ((False, b.column("doc_id").slice(begin, end - begin), keys, links), (True, pa.nulls(1, b.schema.field("doc_id").type), [held], [n])):
                    own = [(0, 0, 0, 0, "")] if part else rows
                    columns = {c: pa.array([r[i] for r in own]) for i, c in enumerate(names)}
                    yield pa.RecordBatch.from_pydict({"doc_id": of, "partial": pa.array([part] * len(own)), **columns, "keys": _lists(k), "links": _lists(m)})

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked), best (is n the highest of its a?). rows: as aligned() gives them."""
    each = rows.where("partial").select(F.explode(F.arrays_zip("keys", "links")).alias("x")).select("x.keys", "x.links")
    total = each.groupBy("keys").agg(F.sum("links").alias("n"))
    a, b = F.shiftright("keys", B_BITS), F.col("keys").bitwiseAND((1 << B_BITS) - 1)
    named = total.select(a.alias("a"), b.alias("b"), "n")  # at most as many rows of one a as B has pieces
    return named.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _looked_up(rows: DataFrame, block: pd.DataFrame) -> DataFrame:
    """rows with the block's share of n_best and count_sum added."""
    held = rows.sparkSession.sparkContext.broadcast((block["key"].to_numpy(np.int32), (block["n"] * 2 + block["best"]).to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, value = held.value
            keys, links = b.column("keys"), b.column("links")
            size = keys.value_lengths().to_numpy(zero_copy_only=False)
            flat, times = keys.flatten().to_numpy(), links.flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(known, flat)
            found = at < len(known)
            found[found] = known[at[found]] == flat[found]
            got = np.where(found, value[np.minimum(at, max(len(known) - 1, 0))] if len(known) else 0, 0)
            cut = np.concatenate([[0], np.cumsum(size)])
            columns = {c: b.column(c) for c in b.schema.names}
            for name, of in (("n_best", (got & 1) * times), ("count_sum", (got >> 1) * times)):
                run_sum = np.concatenate([[0], np.cumsum(of)])
                columns[name] = pa.array(b.column(name).to_numpy() + run_sum[cut[1:]] - run_sum[cut[:-1]])
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, rows.schema)


def align(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    rows = written(aligned(docs, byte_model, piece_model))
    counts = written(pair_counts(rows))
    key = (F.shiftleft("a", B_BITS) + F.col("b")).alias("key")
    blocks = -(-counts.count() // block) or 1
    out = rows.where("not partial").drop("partial").withColumns({c: F.lit(0).cast("long") for c in ("n_best", "count_sum")})
    for k in range(blocks):
        own = counts if blocks == 1 else counts.where(F.pmod(F.xxhash64("a", "b"), F.lit(blocks)) == k)
        before, out = out, _looked_up(out, own.select(key, "n", "best").orderBy("key").toPandas())
        if k < blocks - 1:
            out = written(out)
            discard(before)
    discard(counts)
    names = [c.split()[0] for c in OUT.split(", ")]
    return out.select("doc_id", *names[:4], "n_best", "count_sum", names[4])


def query(spark, sf_dir) -> DataFrame:
    return align(table(spark, sf_dir, "documents", "doc_id", "text"))
