"""Token counts without tokens: count-only Viterbi over an Aho-Corasick automaton of the vocabulary.

The automaton lists every vocabulary piece that ends at each character; dynamic programming keeps the best score and
that path's piece count alone. No piece reaches across a word's start, so a word's count never depends on its
neighbours and is remembered (a bounded memo per worker).

Defined cases: null counts as no tokens (0, like the empty text); a text of any length is counted whole; characters
outside the vocabulary count one piece per UTF-8 byte; repeated rows are counted row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import table
from .pieces import MARK, Counter, Memo, Pieces, chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class TextCounter:
    def __init__(self, pieces: Pieces):
        counter = Counter(pieces)
        self.marked = Memo(lambda w: counter.count(MARK + w))
        self.bare = Memo(counter.count)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        odd, lines = chunks(text)
        if odd:
            return sum(map(self.bare.__getitem__, odd))
        marked, bare = self.marked, self.bare
        total = len(lines) - 1  # line ends: one byte piece each
        for i, line in enumerate(lines):
            first = line.pop(0)
            total += (bare[first] if i else marked[first]) + sum(map(marked.__getitem__, line))
        return total


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), model: str = MODEL) -> DataFrame:
    """The kept columns and n_tokens of each row's text."""
    held = df.sparkSession.sparkContext.broadcast(Pieces.load(model))
    cols = df.select(*keep, df[text].alias("__text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = TextCounter(held.value)
        for b in batches:
            yield b[list(keep)].assign(n_tokens=[count(t) for t in b["__text"]])

    return cols.mapInPandas(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema[:-1]) + ", n_tokens long")


def query(spark, sf_dir) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
