"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum
over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. The piece
probabilities are trained by expectation maximisation (forward-backward over the same segmentations).

Training reads at most ``TRAIN_DOCS`` labelled documents of each language, the first by a hash of doc_id: a bounded,
documented sample, learnt from whole, words of any length included; prediction reads every document whole.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no training rows at all, every text
is; a null lang teaches nothing; ties between languages go to the smaller name; a character outside the vocabulary has
the same small probability in every language; repeated rows are judged row by row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LETTER_BYTES, bound_batches, table
from .pieces import Pieces
from .token_counts import MODEL

TRAIN_DOCS = 256
ROUNDS = 2
UNKNOWN = 1e-7
MEMO = 200_000
#: Characters of a word up to which plain products do not underflow.
LONG = 40
#: Words whose sums are taken at once, and characters of those over LONG.
BLOCK = 4096
STRETCH = 1 << 15


def letter_words(text: str) -> list[bytes]:
    """Lower-cased words, cut at ASCII characters that are no letters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTER_BYTES).split()


class Unigrams:
    """Forward and backward sums over all segmentations, for many words and all languages at once.

    The words stand in one string, each after a line end, so that the automaton lists the pieces of all in one pass;
    sums then go by distance from the words' starts, each step over the edges of all words.
    """

    def __init__(self, pieces: list[str], probabilities: np.ndarray):
        import ahocorasick

        self.p = np.vstack([probabilities, np.full((1, probabilities.shape[1]), UNKNOWN)])  # the last: a character that is no piece
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(pieces):
            self.automaton.add_word(piece, i * 256 + len(piece))
        self.automaton.make_automaton()

    def edges(self, words: list[str]):
        """Nodes at which words start and end; start node, end node and piece of every edge."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(words) else np.zeros(0, np.int64)
        text = "\n".join(words)
        found = np.array([x for pair in self.automaton.iter(text) for x in pair], np.int64).reshape(-1, 2)
        end, size, piece = found[:, 0] + 1, found[:, 1] & 255, found[:, 1] >> 8
        alone = np.ones(len(text), bool)
        alone[end[size == 1] - 1] = False
        alone[first[1:] - 1] = False  # line ends
        lone = np.flatnonzero(alone)
        a, e, i = np.concatenate([end - size, lone]), np.concatenate([end, lone + 1]), np.concatenate([piece, np.full(len(lone), len(self.p) - 1)])
        return first, first + sizes, a, e, i

    @staticmethod
    def steps(key: np.ndarray, far: np.ndarray):
        """Edges by distance; each step: the edges, sorted by key, the distinct keys, and where each begins."""
        order = np.lexsort((key, far))
        cuts = np.flatnonzero(np.diff(far[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            k = key[part]
            at = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1])
            yield part, k[at], at

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.empty((len(words), self.p.shape[1]))
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG]
        first, last, a, e, i = self.edges([words[k] for k in short])
        if short:
            alpha, owner = np.zeros((int(last[-1]) + 1, self.p.shape[1])), np.searchsorted(first, a, "right") - 1
            alpha[first] = 1
            for part, to, at in self.steps(e, e - first[owner]):
                alpha[to] = np.add.reduceat(alpha[a[part]] * self.p[i[part]], at)
            out[short] = np.log(alpha[last])
        for k, w in enumerate(words):
            if not 0 < len(w) <= LONG:
                out[k] = self.long(w)
        return out

    def long(self, word: str) -> np.ndarray:
        """The same for one word of any length, in logarithms."""
        _, _, a, e, i = self.edges([word])
        alpha, p = np.full((len(word) + 1, self.p.shape[1]), -np.inf), np.log(self.p)
        alpha[0] = 0
        for k in np.argsort(e, kind="stable"):
            alpha[e[k]] = np.logaddexp(alpha[e[k]], alpha[a[k]] + p[i[k]])
        return alpha[-1]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected count of each piece in each language; counts: of each word, of any length."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short, far = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        out = self.expected_short([words[k] for k in short], counts[short])
        cuts = np.flatnonzero(np.diff(np.cumsum(size[far]) // STRETCH)) + 1
        for part in np.split(far, cuts) if len(far) else []:
            out += self.expected_long([words[k] for k in part], counts[part])
        return out

    def expected_short(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """The same for words of at most LONG characters, in plain products."""
        if not words:
            return np.zeros((len(self.p) - 1, self.p.shape[1]))
        first, last, a, e, i = self.edges(words)
        owner = np.searchsorted(first, a, "right") - 1
        alpha, beta = (np.zeros((int(last[-1]) + 1, self.p.shape[1])) for _ in "ab")
        alpha[first], beta[last] = 1, 1
        for part, to, at in self.steps(e, e - first[owner]):
            alpha[to] = np.add.reduceat(alpha[a[part]] * self.p[i[part]], at)
        for part, to, at in self.steps(a, last[owner] - a):
            beta[to] = np.add.reduceat(beta[e[part]] * self.p[i[part]], at)
        share = alpha[a] * self.p[i] * beta[e] * (counts / np.maximum(alpha[last], 1e-300))[owner]
        return np.stack([np.bincount(i, share[:, k], len(self.p)) for k in range(share.shape[1])], axis=1)[:-1]

    def expected_long(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """The same in logarithms."""

        def total(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            top = np.maximum.reduceat(x, at)
            return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(at, append=len(x)), axis=0)), at))

        first, last, a, e, i = self.edges(words)
        owner = np.searchsorted(first, a, "right") - 1
        p = np.log(self.p)
        alpha, beta = (np.full((int(last[-1]) + 1, self.p.shape[1]), -np.inf) for _ in "ab")
        alpha[first], beta[last] = 0, 0
        for part, to, at in self.steps(e, e - first[owner]):
            alpha[to] = total(alpha[a[part]] + p[i[part]], at)
        for part, to, at in self.steps(a, last[owner] - a):
            beta[to] = total(beta[e[part]] + p[i[part]], at)
        share = np.exp(alpha[a] + p[i] + beta[e] - alpha[last][owner]) * counts[owner]
        return np.stack([np.bincount(i, share[:, k], len(self.p)) for k in range(share.shape[1])], axis=1)[:-1]


def train(rows: list[tuple[str, str]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the probability of each piece in each."""
    languages = sorted({lang for _, lang in rows})
    at = {lang: k for k, lang in enumerate(languages)}
    seen: Counter = Counter()
    for text, lang in rows:
        seen.update((w, at[lang]) for w in letter_words(text))
    known = sorted({w for w, _ in seen})
    place = {w: k for k, w in enumerate(known)}
    counts = np.zeros((len(known), len(languages)))
    for (w, k), n in seen.items():
        counts[place[w], k] = n
    texts = [w.decode("utf-8", "replace") for w in known]
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds if known else 0):
        model, expected = Unigrams(pieces, p), np.full(p.shape, 0.01)
        for at in range(0, len(texts), BLOCK):
            expected += model.expected(texts[at : at + BLOCK], counts[at : at + BLOCK])
        p = expected / expected.sum(axis=0)
    return languages, p


def sample(labelled: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """At most ``most`` (text, lang) of each language, the first by a hash of doc_id and text. labelled: doc_id, text, lang.

    Rows are thinned by the hash first, to twice what is asked for at least, so that the ranking sees a bounded number.
    """
    labelled = labelled.where("text is not null and lang is not null")
    known = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not known:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in known.items() for x in (lang, 1.0 if n <= 8 * most else 4 * most / n)])
    h = F.xxhash64("doc_id")
    thin = labelled.where(F.pmod(h, F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).select("text", "lang", "doc_id", h.alias("h"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    return [(r["text"], r["lang"]) for r in thin.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most).select("text", "lang").collect()]


class Judge:
    """Texts -> (language, posterior under equal priors) of each; one per worker."""

    def __init__(self, languages: list[str], probabilities: np.ndarray, pieces: list[str]):
        self.names, self.model = languages, Unigrams(pieces, probabilities)
        #: By a word's place: log probabilities, and whether it has a letter.
        self.scores = np.zeros((MEMO + 8 * BLOCK, len(languages) + 1))
        self.memo: dict[bytes, int] = {}

    def place(self, block: list[bytes]) -> np.ndarray:
        memo, scores = self.memo, self.scores
        if new := list(set(block) - memo.keys()):
            if len(memo) + len(new) > len(scores):  # starts afresh, so a worker's memory is bounded
                memo.clear()
                new = list(set(block))
            texts = [w.decode("utf-8", "replace") for w in new]
            at = len(memo)
            scores[at : at + len(new), :-1] = self.model.forward(texts)
            scores[at : at + len(new), -1] = [any(map(str.isalpha, t)) for t in texts]
            memo.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(memo.__getitem__, block), np.int64, len(block))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, preds, best = self.names, [], []
        for at in range(0, len(texts), 64):  # new words of many documents are summed at once
            group = [letter_words(t) if t and names else [] for t in texts[at : at + 64]]
            total = np.zeros((len(group), len(names) + 1))
            row = np.repeat(np.arange(len(group)), list(map(len, group)))
            flat = [w for ws in group for w in ws]
            for k in range(0, len(flat), 8 * BLOCK):
                np.add.at(total, row[k : k + 8 * BLOCK], self.scores[self.place(flat[k : k + 8 * BLOCK])])
            top = np.argmax(total[:, :-1], axis=1) if names else [0] * len(group)
            for t, j in zip(total, top, strict=True):
                sure = t[-1] > 0
                preds.append(names[j] if sure else "und")
                best.append(float(1 / np.exp(np.minimum(t[:-1] - t[j], 0)).sum()) if sure else 0.0)
        return preds, best


def predict(docs: DataFrame, model: tuple, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row's whole text. model: languages, probabilities, pieces."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(*keep, docs["text"].alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(*held.value)
        for b in batches:
            preds, scores = judge(b["__text"].tolist())
            yield b[list(keep)].assign(lang_pred=preds, score=scores)

    return cols.mapInPandas(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema[:-1]) + "lang_pred string, score double")


def vocabulary(model: str = MODEL) -> list[str]:
    """Lower-case pieces of the public vocabulary, without marks; pieces that are the same then count once."""
    from .pieces import MARK

    return sorted({p.replace(MARK, "") for p, _, _ in Pieces.load(model).pieces if p.replace(MARK, "") and p == p.lower()})


def held_out() -> Column:
    """Rows of the fold that is never learnt from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, model: str = MODEL) -> tuple:
    """Languages, probabilities and pieces, learnt from documents outside the held-out fold. docs: doc_id, text, lang."""
    pieces = vocabulary(model)
    return (*train(sample(docs.where(~held_out()).select("doc_id", "text", "lang")), pieces), pieces)


def known(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, whose language can be told; ``und`` goes."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("boolean")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = Judge(*held.value)
        for texts in batches:
            yield pd.Series([p != "und" for p in judge(texts.tolist())[0]], dtype=bool)

    return docs.where(told("text"))


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
