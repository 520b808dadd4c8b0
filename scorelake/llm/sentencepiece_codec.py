"""SentencePiece encoding by streaming Viterbi, and decoding.

``Streaming`` (pieces.py) reads characters one by one, keeps candidates as far back as the longest piece, and commits
ids whenever all surviving back paths meet in one boundary. A text is one stream, fed in chunks that end where no piece
can reach across (before a run of spaces, around a line end); there the paths have always met, so the stream is empty
again, and inside a chunk they are looked for after every STEP characters. An empty stream gives a chunk the same ids
every time, so a worker may remember them (a bounded memo, which changes no id and can be turned off).

Defined cases: null encodes to an empty list of ids, like the empty text, and decodes to ''; texts are encoded whole;
characters outside the vocabulary become byte pieces and decode exactly; a literal U+2581 decodes to a space, as in the
library (``lossless`` is then false); repeated rows are encoded row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, table
from .pieces import MARK, MEMO, Memo, Pieces, Streaming, chunks
from .token_counts import MODEL


class Codec:
    def __init__(self, pieces: Pieces, memo: bool = True):
        self.p, self.automaton = pieces, pieces.automaton()
        most = MEMO if memo else 0
        self.marked = Memo(lambda w: self.through(MARK + w), most)
        self.bare = Memo(self.through, most)

    def through(self, chunk: str) -> tuple[int, ...]:
        """The ids that the text's stream commits on a chunk."""
        return tuple(self.stream.push(chunk) + self.stream.settle())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        self.stream = Streaming(self.p, self.automaton)
        odd, lines = chunks(text)
        ids: list[int] = []
        if odd:
            for c in odd:
                ids += self.bare[c]
            return ids
        marked, newline = self.marked, self.bare["\n"]
        for i, line in enumerate(lines):
            first = line.pop(0)
            if i:
                ids += newline
                ids += self.bare[first]
            else:
                ids += marked[first]
            for w in line:
                ids += marked[w]
        return ids

    def decode(self, ids) -> str:
        """The text of ids; the leading space that encoding adds goes; unknown ids give nothing; bad bytes become U+FFFD."""
        texts = self.p.texts
        out = b"".join([texts[i] for i in ids if 0 <= i < len(texts)])
        return out.removeprefix(b" ").decode("utf-8", "replace")


def _kept(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = [0]
    for v in values:
        offsets.append(offsets[-1] + len(v))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([i for v in values for i in v], pa.int32()))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL, check: bool = False) -> DataFrame:
    """The kept columns, ids and n_ids; with check also decoded_sha256 and lossless, from decoding the ids again."""
    bound_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounds the ids held at once
                b = whole.slice(at, 256)
                texts = b.column(b.num_columns - 1).to_pylist()
                ids = [codec.encode(t) for t in texts]
                cols = {n: b.column(i) for i, n in enumerate(keep)} | {"ids": _lists(ids), "n_ids": pa.array([len(x) for x in ids], pa.int64())}
                if check:
                    back = [codec.decode(x) for x in ids]
                    cols |= {"decoded_sha256": pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back]), "lossless": pa.array([x == (t or "") for x, t in zip(back, texts, strict=True)])}
                yield pa.RecordBatch.from_pydict(cols)

    schema = _kept(df, keep) + "ids array<int>, n_ids long" + ", decoded_sha256 string, lossless boolean" * check
    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The kept columns and the text that the ids stand for."""
    held = df.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(held.value)
        for b in batches:
            texts = [codec.decode(x or []) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_pydict({n: b.column(i) for i, n in enumerate(keep)} | {"text": pa.array(texts, pa.string())})

    return df.select(*keep, df[ids].alias("__ids")).mapInArrow(run, _kept(df, keep) + "text string")


def query(spark, sf_dir) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), check=True)
