"""Toxicity by a counterfactual-regularised logistic classifier.

Features are whether a word occurs in the text, and whether a word with a given beginning of 4, 5 or 6 characters does.
Every labelled text gives counterfactual pairs. If it names identity groups, each term is swapped for each other term of
its kind. In any case a term, chosen by a hash of the text, is put in and then swapped for the others of its kind. The
squared change of the score's logit over a pair is penalised, so that weight cannot settle on the mention of a group,
nor on word beginnings that a group's name shares with other words.

A feature may have weight only if at least LEAST labelled texts have it, LEAST_TOXIC toxic ones among them, and toxic
texts have it LIFT times as often as all texts: a word that the sample lacks, or that tells little, cannot make a text
toxic. Features of identity terms may have weight whenever a labelled text has them; the penalty decides about them.

Training reads at most ``TRAIN_DOCS`` labelled documents, the first by a hash of doc_id: a bounded, documented sample.
Their whole texts go to the driver.
Scoring reads every text whole; only doc_id's fold decides which labels may be learnt from, and nothing but the text
is an input of a score.

Defined cases: null and word-less texts get the score of a text without features; a null label teaches nothing; with
no labels at all every score is 0.5 less a hair, so nothing is predicted toxic; conflicting labels of one document are
averaged; repeated rows are scored row by row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import table, words
from .pieces import Memo

TRAIN_DOCS = 8192
LEAST, LEAST_TOXIC, LIFT = 3, 2, 1.5
#: Identity terms by kind; a term is swapped for the others of its kind.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("black", "white", "asian", "african", "european", "arab", "latino"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
_TERMS = sorted(t.encode() for kind in IDENTITY for t in kind)
_KIND = {t.encode(): [o.encode() for o in kind if o != t] for kind in IDENTITY for t in kind}


def features(word: bytes) -> tuple[str, ...]:
    """A word itself and its beginnings."""
    w = word.decode("utf-8", "replace")
    return (w, *(f"{w[:n]}~" for n in (4, 5, 6) if len(w) >= n))


class Classifier:
    """weights by feature, the intercept, and how many counterfactual pairs the fit had, and had with features that count."""

    def __init__(self, weights: dict[str, float], intercept: float, pairs: int = 0, active: int = 0):
        self.weights, self.intercept, self.pairs, self.active = weights, intercept, pairs, active

    def scorer(self):
        """text -> probability. Per word, the features with weight are remembered; each counts once in a text."""
        weights = self.weights
        memo = Memo(lambda w: tuple(f for f in features(w) if f in weights))

        def score(text: str | None) -> float:
            found = {f for x in map(memo.__getitem__, set(words(text))) if x for f in x}
            z = self.intercept + math.fsum(weights[f] for f in found)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def fit(rows: list[tuple[str | None, float]], least: int = LEAST, l2: float = 0.1, swap: float = 1.0, rounds: int = 400, sparse: float = 0.03) -> Classifier:
    """Accelerated proximal gradient on log loss + swap * (change of the logit under a swap)**2 + l2 + l1.

    Features of fewer than ``least`` texts are left out, and so are those that toxic texts do not have more often: a
    missing feature must not make a text toxic.
    """
    if not rows:
        return Classifier({}, -1e-6)
    y = np.array([v for _, v in rows], float)
    names: dict[str, int] = {}
    ids = Memo(lambda w: [names.setdefault(f, len(names)) for f in features(w)], 1 << 62)  # of a bounded sample
    of = lambda seen: np.unique(np.fromiter((k for w in seen for k in ids[w]), np.int32))
    sets = []
    swaps: dict[tuple[bytes, bytes], int] = Counter()  # features that a change takes away and adds, and how often
    total = 0

    def change(old: np.ndarray, new: np.ndarray) -> None:
        nonlocal total
        total += 1
        swaps[np.setdiff1d(old, new).tobytes(), np.setdiff1d(new, old).tobytes()] += 1

    for text, _ in rows:
        seen = set(words(text))
        sets.append(old := of(seen))
        for term in sorted(seen & _KIND.keys()):
            for other in _KIND[term]:
                change(old, of(seen - {term} | {other}))
        put = _TERMS[zlib.crc32(b" ".join(sorted(seen))) % len(_TERMS)]
        if put not in seen:
            named = of(seen | {put})
            change(old, named)
            for other in _KIND[put]:
                change(named, of(seen | {other}))
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in sets])
    del sets
    df = np.bincount(every, minlength=len(names))
    toxic = np.bincount(every[(y >= 0.5)[owner]], minlength=len(names))
    base = y.mean()
    named = np.zeros(len(names), bool)
    named[[names[f] for t in _TERMS for f in features(t) if f in names]] = True
    chosen = np.flatnonzero((df >= least) & (toxic > LIFT * base * df) & (toxic >= LEAST_TOXIC) | named & (df > 0))
    place = np.full(len(names), -1, np.int32)
    place[chosen] = np.arange(len(chosen), dtype=np.int32)
    every = place[every]
    known = every >= 0
    idx, owner, n, d = every[known], owner[known], len(rows), len(chosen)
    del every, known
    words_by_id = list(names)
    at = {words_by_id[k]: j for j, k in enumerate(chosen)}
    local = lambda b: (k := place[np.frombuffer(b, np.int32)])[k >= 0]
    weighed = [(local(m), local(p), many) for (m, p), many in swaps.items()]
    weighed = [x for x in weighed if len(x[0]) or len(x[1])]
    changes, many = [x[:2] for x in weighed], np.array([x[2] for x in weighed], float)
    active = int(many.sum())
    pair = np.repeat(np.arange(len(changes)), [len(m) + len(p) for m, p in changes])
    where = np.concatenate([k for m, p in changes for k in (m, p)]) if changes else np.zeros(0, np.int64)
    sign = np.concatenate([v for m, p in changes for v in (np.full(len(m), -1.0), np.full(len(p), 1.0))]) if changes else np.zeros(0)
    w, b, prior, ahead = np.zeros(d), math.log((base + 1e-3) / (1 - base + 1e-3)), 0.0, np.zeros(d)
    per_row = np.bincount(owner, minlength=n) if len(idx) else np.zeros(n)
    step = 1 / (0.25 * (1 + float((per_row**2).mean()) ** 0.5) + l2 / n + 2 * swap * max((len(m) + len(p) for m, p in changes), default=0))
    t, last = 1.0, w
    for _ in range(rounds):
        z = b + np.bincount(owner, ahead[idx], n) if len(idx) else np.full(n, b)
        r = (1 / (1 + np.exp(-z)) - y) / n
        g = (np.bincount(idx, r[owner], d) if len(idx) else np.zeros(d)) + l2 / n * ahead
        if len(changes):
            delta = np.bincount(pair, sign * ahead[where], len(changes)) * many
            g += 2 * swap / active * np.bincount(where, sign * delta[pair], d)
        w = ahead - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse / math.sqrt(n), 0)
        b -= 4 * r.sum()
        t, prior = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, last = w + (prior - 1) / t * (w - last), w
    return Classifier({f: float(w[k]) for f, k in at.items() if w[k]}, float(b), total, active)


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> list[tuple[str | None, float]]:
    """At most ``most`` (text, label), the first by a hash of doc_id. docs: doc_id, text; labels: doc_id, label, one row each.

    The ids are chosen first, without texts, and then sent to where the texts are: at most ``most`` of them.
    """
    h = F.xxhash64("doc_id")
    chosen = labels.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(h, "doc_id").limit(most)
    rows = docs.join(F.broadcast(chosen), "doc_id")
    return [(r["text"], float(r["label"])) for r in rows.orderBy(h, "doc_id", "text").limit(most).select("text", "label").collect()]


def score(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the score of every row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(*keep, docs["text"].alias("__text"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = held.value.scorer()
        for b in batches:
            yield b[list(keep)].assign(score=[of(t) for t in b["__text"]])

    return cols.mapInPandas(judge, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema[:-1]) + "score double")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.avg("toxic").alias("label"))
    model = fit(sample(docs, labels))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
