"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

Every leaf block is labelled article (1) or not (0). Features are the tags above the block with the words of their
class, id, role and itemprop attributes, and the block's text: length, share inside links, end mark, digits. Weights
are trained by the conditional likelihood on labelled pages (html_pages.py); Viterbi decodes a page.

Defined cases: a null or empty page, or one without an article block, has the empty text; scripts, styles, forms'
controls and other raw elements are no blocks; a block that is hidden by attribute or inline style is seen as such by
the features, so it is left out; pages of any length are read whole; repeated rows are read row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import html_pages
from .common import table
from .html_blocks import Block, Path, blocks

_WORD = re.compile(r"[a-z]+")


@lru_cache(20_000)
def step_features(step: str) -> frozenset[str]:
    """Of one open block: its tag, and the words of its attributes."""
    tag, *attrs = step.split(".")
    pairs = (a.partition("=") for a in attrs)
    return frozenset([f"in={tag}", *(f"{name}={w}" for name, _, value in pairs for w in _WORD.findall(value.lower()))])


def _tag(path: Path | None) -> str:
    return path.step.partition(".")[0] if path else ""


def own_features(path: Path | None) -> tuple[str, str]:
    """Of the innermost two tags."""
    own = _tag(path)
    return f"own={own}", f"own2={_tag(path.above)}/{own}" if path and path.above else f"own2={own}"


def path_features(path: Path | None) -> tuple[str, ...]:
    """Of the tags above a block: each tag anywhere, words of each attribute anywhere, and the innermost two tags."""
    found, at = set(own_features(path)) | (set() if path else {"in="}), path
    while at:
        found |= step_features(at.step)
        at = at.above
    return tuple(sorted(found))


class _Above:
    """Score of all that is above a block, kept from block to block: only tags that were opened or closed between are looked at."""

    def __init__(self, weights: dict[str, tuple[float, float]]):
        self.w, self.open, self.sums, self.seen = weights, [], [(0.0, 0.0)], Counter()
        self.none = weights.get("in=", (0.0, 0.0))

    def __call__(self, path: Path | None) -> tuple[float, float]:
        new, at = [], path
        while at and not (at.depth < len(self.open) and self.open[at.depth] is at):
            new.append(at)
            at = at.above
        while len(self.open) > (at.depth + 1 if at else 0):
            self.seen.subtract(step_features(self.open.pop().step))
            self.sums.pop()
        for node in reversed(new):
            x, y = self.sums[-1]
            for f in step_features(node.step):
                if not self.seen[f] and f in self.w:
                    x, y = x + self.w[f][0], y + self.w[f][1]
                self.seen[f] += 1
            self.open.append(node)
            self.sums.append((x, y))
        x, y = self.sums[-1] if path else self.none
        for f in own_features(path):
            a, b = self.w.get(f, (0.0, 0.0))
            x, y = x + a, y + b
        return x, y


def text_features(b: Block) -> tuple[str, ...]:
    t, n = b.text, len(b.text)
    share = min(b.linked / n, 1.0)
    return (
        f"size={min(n.bit_length(), 10)}",
        "link=none" if not share else "link=some" if share < 0.5 else "link=most",
        "end=stop" if t[-1] in ".!?:;\"'" else "end=open",
        "has=copy" if "©" in t else "has=none",
    )


class Crf:
    """weights: feature -> (score of label 0, of label 1); between: between[i][j] for label j after i."""

    def __init__(self, weights: dict[str, tuple[float, float]], between: list[list[float]], first: list[float]):
        self.weights, self.between, self.first = weights, between, first

    def decoder(self):
        w = self.weights
        total = lambda fs: tuple(sum(w[f][k] for f in fs if f in w) for k in (0, 1))
        of_text = lru_cache(4096)(total)
        (s00, s01), (s10, s11) = self.between

        def decode(page: list[Block]) -> list[int]:
            back, x, y = [], *self.first
            of_path = _Above(w)
            for k, b in enumerate(page):
                (p0, p1), (t0, t1) = of_path(b.path), of_text(text_features(b))
                if k:
                    a0, a1, b0, b1 = x + s00, y + s10, x + s01, y + s11
                    back.append((a1 > a0, b1 > b0))
                    x, y = max(a0, a1), max(b0, b1)
                x, y = x + p0 + t0, y + p1 + t1
            label, out = int(y > x), []
            for choice in reversed(back):
                out.append(label)
                label = int(choice[label])
            return [label, *reversed(out)] if page else []

        return decode


def train(pages: list[str] | None = None, rounds: int = 250, l2: float = 1e-3) -> Crf:
    """Maximises the conditional log likelihood of the labels; forward-backward runs over all pages at once."""
    names: dict[str, int] = {}
    rows, labels = [], []
    for html in pages if pages is not None else html_pages.labelled():
        found = blocks(html)
        labels.append([int("\ue001" in b.text) for b in found])
        found = [b._replace(text=b.text.replace("\ue000", "").replace("\ue001", "").strip() or "-") for b in found]
        rows.append([[names.setdefault(f, len(names)) for f in (*path_features(b.path), *text_features(b))] for b in found])
    n, most = len(rows), max(map(len, rows))
    y, live = np.zeros((n, most), int), np.zeros((n, most), bool)
    for k, ls in enumerate(labels):
        y[k, : len(ls)], live[k, : len(ls)] = ls, True
    idx = np.array([f for r in rows for fs in r for f in fs])
    at = np.repeat(np.flatnonzero(live.ravel()), [len(fs) for r in rows for fs in r])
    d = len(names)
    w, between, first = np.zeros((d, 2)), np.zeros((2, 2)), np.zeros(2)
    gold = np.stack([np.bincount(idx, y.ravel()[at] == c, d) for c in (0, 1)], axis=1)
    pairs = live[:, 1:]
    gold_between = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    gold_first = np.array([(y[:, 0] == c).sum() for c in (0, 1)], float)
    square = [np.full(v.shape, 1e-8) for v in (w, between, first)]
    for _ in range(rounds):
        e = np.stack([np.bincount(at, w[idx, c], n * most) for c in (0, 1)], axis=1).reshape(n, most, 2)
        f, b = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        f[:, 0] = e[:, 0] + first
        for t in range(1, most):
            f[:, t] = np.where(live[:, t, None], e[:, t] + np.logaddexp(f[:, t - 1, :1] + between[0], f[:, t - 1, 1:] + between[1]), f[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = np.logaddexp(between[:, 0] + (e[:, t + 1] + b[:, t + 1])[:, :1], between[:, 1] + (e[:, t + 1] + b[:, t + 1])[:, 1:])
            b[:, t] = np.where(live[:, t + 1, None], step, 0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p = np.exp(f + b - z[:, None, None])
        joint = np.exp(f[:, :-1, :, None] + between + (e + b)[:, 1:, None, :] - z[:, None, None, None])
        gradients = (
            np.stack([np.bincount(idx, p[..., c].ravel()[at], d) for c in (0, 1)], axis=1) - gold + l2 * n * w,
            (joint * pairs[..., None, None]).sum(axis=(0, 1)) - gold_between,
            p[:, 0].sum(axis=0) - gold_first,
        )
        for v, g, s in zip((w, between, first), gradients, square, strict=True):
            s += g * g
            v -= 0.5 * g / np.sqrt(s)
    return Crf({f: (float(w[k, 0]), float(w[k, 1])) for f, k in names.items()}, between.tolist(), first.tolist())


def extract(pages: DataFrame, model: Crf | None = None, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The kept columns, text and n_chars of every page."""
    held = pages.sparkSession.sparkContext.broadcast(model or train())
    cols = pages.select(*keep, pages[html].alias("__html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = held.value.decoder()
        for b in batches:
            texts = []
            for h in b["__html"]:
                found = blocks(h)
                texts.append("\n".join([x.text for x, label in zip(found, decode(found), strict=True) if label]))
            yield b[list(keep)].assign(text=texts, n_chars=[len(t) for t in texts])

    return cols.mapInPandas(run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema[:-1]) + "text string, n_chars long")


def query(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
