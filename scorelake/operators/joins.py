"""Joins beyond equality: points in intervals, contained intervals, as-of, matching."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import algorithms


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, keys: Sequence[str] = (), width: float = 60.0, closed: bool = False) -> DataFrame:
    """Pairs of a point and an interval around it, strictly inside unless closed.

    Time is cut into bins of the given width; an interval stands in every bin that it touches, a point in one, so this
    is a hash join on the keys and the bin.
    """
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    i = intervals.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.greatest(F.floor(F.col(end) / width), F.floor(F.col(start) / width)))))
    joined = p.join(i, [*keys, "__bin"]).drop("__bin")
    if closed:
        return joined.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))
    return joined.where((F.col(at) > F.col(start)) & (F.col(at) < F.col(end)))


def contained(outer: DataFrame, inner: DataFrame, begin: str, finish: str, start: str, end: str, keys: Sequence[str], width: float = 60.0) -> DataFrame:
    """Pairs in which [start, end) of inner begins inside [begin, finish) of outer and does not outlast it."""
    o = outer.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor(F.col(finish) / width))))
    i = inner.withColumn("__bin", F.floor(F.col(start) / width))
    return o.join(i, [*keys, "__bin"]).drop("__bin").where((F.col(start) >= F.col(begin)) & (F.col(end) <= F.col(finish)))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str) -> DataFrame:
    """Each left row with the latest right row of its key not after it, by one sort of both."""
    values = [c for c in right.columns if c not in keys]
    l = left.withColumn("__t", F.col(at)).withColumn("__side", F.lit(1)).withColumn("__r", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    r = right.select(*keys, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__r"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *[F.col("__r")[v].alias(v) for v in values])


def image_pointers(df: DataFrame, key: str = "index", image: str = "image", most: int = 64) -> DataFrame:
    """Images of at most ``most`` characters are keys of the rows that hold them."""
    held = df.where(F.length(image) > most).select(F.col(key).cast("string").alias("__k"), F.col(image).alias("__i"))
    joined = df.join(held, (F.length(image) <= most) & (F.col(image) == F.col("__k")), "left")
    return joined.withColumn(image, F.coalesce("__i", image)).drop("__k", "__i")


def interleave(frames: DataFrame, subtitles: DataFrame, keys: Sequence[str], at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Frames and subtitles in one order: a frame comes before a subtitle whose midpoint it does not pass; subtitles
    without a frame inside go; those under a second are widened to half a second around the midpoint."""
    mid = (F.col(start) + F.col(end)) / 2
    short = F.col(end) - F.col(start) < 1
    wide = subtitles.withColumns({"__mid": mid, "__s": F.when(short, mid - 0.5).otherwise(F.col(start)), "__e": F.when(short, mid + 0.5).otherwise(F.col(end))})
    seen = points_in_intervals(frames.select(*keys, at), wide.select(*keys, start, end, "__s", "__e"), at, "__s", "__e", keys).select(*keys, start, end).distinct()
    kept = wide.join(seen, [*keys, start, end], "left_semi").select(*keys, F.col("__mid").alias("order"), F.lit("subtitle").alias("kind"), start, end)
    return frames.select(*keys, F.col(at).alias("order"), F.lit("frame").alias("kind")).unionByName(kept, allowMissingColumns=True)


def update_join(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """base with the columns of new in place of its own where new has a value."""
    n = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in new.columns if c != key])
    j = base.join(n, key)
    return j.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new.columns and c != key else F.col(c) for c in base.columns], *[F.col(f"__{c}").alias(c) for c in new.columns if c not in base.columns])


def prefer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union in which a's row wins over b's of the same key."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost matching of rows to columns (each once), by shortest augmenting paths."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            free = ~used[1:]
            reduced = c[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    found = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in found)


def levenshtein(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences of any values."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


#: Pairs of texts that are held at once.
PAIRS = 2_000_000


def match_lines(df: DataFrame) -> DataFrame:
    """df: page, targets, preds (arrays of text). Pairs of least total edit distance over the longer length; targets
    without a partner have edit 1; all predictions without one make one row, joined, with edit 1."""

    def scored(pages):
        """Rows of pages, whose distances are taken at once."""
        lines = list(dict.fromkeys(x for _, t, p in pages for x in (*t, *p)))
        at = {x: k for k, x in enumerate(lines)}
        own = [(np.array([at[x] for x in t], int), np.array([at[y] for y in p], int)) for _, t, p in pages]
        dist = algorithms.edit_distances(lines, lines, np.concatenate([np.repeat(x, len(y)) for x, y in own]), np.concatenate([np.tile(y, len(x)) for x, y in own]))
        begin, out = 0, []
        for page, t, p in pages:
            longer = np.maximum(np.array(list(map(len, t)), int)[:, None], np.array([max(len(y), 1) for y in p], int)[None, :])
            cost = dist[begin : begin + len(t) * len(p)].reshape(len(t), len(p)) / longer
            begin += len(t) * len(p)
            pairs = assignment(cost) if t and p else []
            out += [(page, t[i], p[j], float(cost[i, j])) for i, j in pairs]
            got, used = {i for i, _ in pairs}, {j for _, j in pairs}
            out += [(page, t[i], "", 1.0) for i in range(len(t)) if i not in got]
            if rest := [p[j] for j in range(len(p)) if j not in used]:
                out.append((page, "", "".join(rest), 1.0))
        return pd.DataFrame(out, columns=["page", "target", "pred", "edit"])

    def run(batches):
        for b in batches:
            pages, n = [], 0
            for page, targets, preds in zip(b["page"], b["targets"], b["preds"], strict=True):
                t, p = list(targets if targets is not None else []), list(preds if preds is not None else [])
                if pages and n + len(t) * len(p) > PAIRS:
                    yield scored(pages)
                    pages, n = [], 0
                pages.append((page, t, p))
                n += len(t) * len(p)
            if pages:
                yield scored(pages)

    return df.select("page", "targets", "preds").mapInPandas(run, "page long, target string, pred string, edit double")


def nearest_texts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id and dist of the nearest text for each item. texts: doc_id, text; items: item_id, text.

    The distance is the edit distance of the lower-cased, space-collapsed texts over the longer length of the texts as
    they are. It is at least the difference of the collapsed lengths over that length, so pairs go by this bound, nearest first,
    until the bound is beyond the item's best: no pair is dropped that could win or tie.
    """
    key = "item_id"
    held = [(r[key], r["text"]) for r in items.distinct().collect()]
    plain = lambda x: " ".join(x.lower().split())
    raw = [x for _, x in held if x is not None]
    known = texts.sparkSession.sparkContext.broadcast(([plain(x) for x in raw], [len(x.upper()) for x in raw]))

    def run(batches):
        patterns, longer = known.value
        m, wide = np.array([len(x) for x in patterns], np.int64), np.array(longer, np.int64)
        best, who = np.full(len(m), np.inf), [None] * len(m)
        rows = max(1, PAIRS // max(len(m), 1))
        for b in batches:
            b = b[b["text"].notna() & b["doc_id"].notna()]
            for at in range(0, len(b) if len(m) else 0, rows):
                ids, whole = b["doc_id"].tolist()[at : at + rows], b["text"].tolist()[at : at + rows]
                docs = [plain(x) for x in whole]
                n, far = np.array([len(x) for x in docs], np.int64), np.array([len(x.upper()) for x in whole], np.int64)
                longest = np.maximum(np.maximum(far[:, None], wide[None, :]), 1)
                least = np.abs(n[:, None] - m[None, :]) / longest
                near = np.flatnonzero(least <= best[None, :])
                near = near[np.argsort(least.ravel()[near], kind="stable")]
                size = algorithms.LANES
                while len(near):
                    part, near = near[:size], near[size:]
                    q, p = np.divmod(part, len(m))
                    keep = least[q, p] <= best[p]
                    q, p = q[keep], p[keep]
                    dist = algorithms.edit_distances(patterns, docs, p, q) / longest[q, p]
                    for d, i, k in zip(dist.tolist(), q.tolist(), p.tolist(), strict=True):
                        if d < best[k] or d == best[k] and ids[i] < who[k]:
                            best[k], who[k] = d, ids[i]
        found = [k for k in range(len(m)) if who[k] is not None]
        yield pd.DataFrame({"k": found, "doc_id": [who[k] for k in found], "dist": best[found]})

    kind, name = texts.schema["doc_id"].dataType.simpleString(), items.schema[key].dataType
    near = texts.select("doc_id", "text").mapInPandas(run, f"k long, doc_id {kind}, dist double").groupBy("k").agg(F.min(F.struct("dist", "doc_id")).alias("m"))
    place = iter(range(len(raw)))
    numbered = [(next(place) if x is not None else None, i) for i, x in held]
    own = texts.sparkSession.createDataFrame(numbered, StructType([StructField("k", LongType()), StructField(key, name)]))
    each = own.join(near, "k", "left").groupBy(key).agg(F.min("m").alias("m"))
    return each.select(key, "m.doc_id", F.round("m.dist", 6).alias("dist"))


def greedy_matches(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Takes the largest score, drops its row and column, and so on while scores are above 0."""
    s, out = scores.astype(float).copy(), []
    while s.size and (best := s.max()) > 0:
        i, j = np.unravel_index(int(s.argmax()), s.shape)
        out.append((int(i), int(j), float(best)))
        s[i, :] = s[:, j] = -1
    return out
