"""What a chart draws against what it should draw: items of a kind taken off one by one, colours and clusters matched as wholes.

A chart is named by ``keys``. Scores of pairs are Column expressions over joined rows; only the matching of one chart's lists
(a matrix of its own colours or clusters) goes through Arrow.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import colours
from ..functions.geometry import _let, iou, time_iou
from .joins import assignment


def rates(hits: Column, preds: Column, targets: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; 0 where nothing is predicted, wanted or met."""
    p, r = F.coalesce(F.try_divide(hits, preds), F.lit(0.0)), F.coalesce(F.try_divide(hits, targets), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def consumed(targets: DataFrame, preds: DataFrame, keys: Sequence[str], item: Sequence[str]) -> DataFrame:
    """keys, preds, targets, hits: every target takes one equal prediction off, so an item counts as often as both sides have it.

    Counted before they meet, so a side of any size is one row an item. Nulls in an item equal nulls; a chart on either side has a row.
    """
    names = [*keys, *item]
    count = lambda df, p, g: df.groupBy(*names).agg(F.count("*").alias("n")).select(*names, (F.col("n") * p).alias("p"), (F.col("n") * g).alias("g"))
    each = count(preds, 1, 0).unionByName(count(targets, 0, 1)).groupBy(*names).agg(F.sum("p").alias("p"), F.sum("g").alias("g"))
    return each.groupBy(*keys).agg(F.sum("p").alias("preds"), F.sum("g").alias("targets"), F.sum(F.least("p", "g")).alias("hits"))


def consumed_near(targets: Column, preds: Column, same) -> Column:
    """How many targets of an array, in their order, take off the first prediction left that is the ``same``."""

    def step(acc: Column, t: Column) -> Column:
        at = F.array_position(F.transform(acc["left"], lambda p: F.coalesce(same(t, p), F.lit(False))), True).cast("int")
        rest = lambda i: F.filter(acc["left"], lambda _, k: k != i - 1)
        return _let(at, lambda i: F.when(i > 0, F.struct(rest(i).alias("left"), (acc["n"] + 1).alias("n"))).otherwise(acc))

    return F.aggregate(targets, F.struct(preds.alias("left"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def placed_text(reach: float = 10.0):
    """Equal texts no further than ``reach`` apart in x and y, for ``consumed_near``: struct<text, x, y>."""
    return lambda t, p: (t["text"] == p["text"]) & (F.abs(t["x"] - p["x"]) <= reach) & (F.abs(t["y"] - p["y"]) <= reach)


#: Matrices with at most so many ways to match them are matched by trying all ways, those of one shape at once.
WAYS = 120


def _within(group: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value among those of its group, and how many a group has."""
    codes, known = pd.factorize(values, use_na_sentinel=False)
    each, at = np.unique(group * max(len(known), 1) + codes, return_inverse=True)
    own = each // max(len(known), 1)
    return (np.arange(len(each)) - np.searchsorted(own, own))[at], np.bincount(own, minlength=n)


def _totals(group: np.ndarray, i: np.ndarray, j: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Largest sum of scores of one-to-one pairs in each of n groups; pairs that are not there score 0."""
    (r, rows), (c, columns) = _within(group, i, n), _within(group, j, n)
    turned = (rows > columns)[group]
    r, c = np.where(turned, c, r), np.where(turned, r, c)
    few, many = np.minimum(rows, columns), np.maximum(rows, columns)
    shape, out = few * (many.max(initial=0) + 1) + many, np.zeros(n)
    order = np.argsort(shape[group], kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(shape[group][order])) + 1) if len(order) else []
    for part in parts:
        own, at = np.unique(group[part], return_inverse=True)
        a, b = int(few[own[0]]), int(many[own[0]])
        m = np.zeros((len(own), a, b))
        np.maximum.at(m, (at, r[part], c[part]), score[part])
        if math.perm(b, a) > WAYS:
            out[own] = [sum(x[k, l] for k, l in assignment(-x)) for x in m]
        elif a == 1:
            out[own] = m[:, 0].max(axis=1)
        else:
            for way in itertools.permutations(range(b), a):
                out[own] = np.maximum(out[own], m[:, np.arange(a), way].sum(axis=1))
    return out


def _matched(lists: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and total of rows with keys and arrays _b, _i, _j, _s: pairs (i, j) with a score above 0, matched in each block b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, i, j, s = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("_b", "_i", "_j", "_s"))
            row = np.repeat(np.arange(len(batch)), np.diff(batch["_b"].offsets.to_numpy()))
            codes, known = pd.factorize(b, use_na_sentinel=False)
            each, group = np.unique(row * max(len(known), 1) + codes, return_inverse=True)
            totals = _totals(group, i, j, np.asarray(s, float), len(each))
            total = np.bincount(each // max(len(known), 1), totals, minlength=len(batch))
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(total, pa.float64())], names=[*keys, "total"])

    schema = T.StructType([*[lists.schema[k] for k in keys], T.StructField("total", T.DoubleType())])
    return lists.select(*keys, "_b", "_i", "_j", "_s").mapInArrow(run, schema)


def best_total(pairs: DataFrame, keys: Sequence[str], left: str = "i", right: str = "j", score: str = "score") -> DataFrame:
    """keys and total: the largest sum of scores of one-to-one pairs. pairs: keys, two ids, score; pairs that are not there
    score 0, repeated ones the most of theirs. A group is one matrix of its own ids."""
    keys = list(keys)
    some = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(score) > 0)).groupBy(*keys).agg(F.collect_list(F.struct(left, right, score)).alias("_all"))
    lists = some.select(*keys, F.transform("_all", lambda _: F.lit(0)).alias("_b"), *[F.col("_all")[n].alias(c) for n, c in ((left, "_i"), (right, "_j"), (score, "_s"))])
    return _matched(lists, keys)


def colour_scores(targets: DataFrame, preds: DataFrame, keys: Sequence[str], kind: str = "kind", colour: str = "colour", order: str = "place", most: int = 10) -> DataFrame:
    """keys, preds, targets, total, precision, recall, f1. Each side: keys, kind of what is drawn, colour, place.

    A side's colours count once a kind; of more than ``most`` of them, those like an earlier one (whatever its kind) go. Colours of a kind are matched
    at most total likeness. Null kinds and colours are none; a chart on one side only has zeros.

    A chart's rows meet once, sorted, and go in Arrow batches cut between charts.
    """
    keys = list(keys)
    side = lambda df, n: df.select(*keys, F.lit(n).alias("_side"), F.col(order).alias("_o"), F.col(kind).alias("_k"), F.col(colour).alias("_c"))
    some = side(targets, 0).unionByName(side(preds, 1)).where("_k IS NOT NULL AND _c IS NOT NULL")
    rows = some.repartition(*keys).sortWithinPartitions(*keys, "_o", "_k", "_c").drop("_o")

    def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        d = column.combine_chunks().dictionary_encode(null_encoding="encode")
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        for k in keys:
            codes, _ = coded(t[k])
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def told(t: pa.Table) -> pa.RecordBatch:
        new = begins(t)
        chart = np.cumsum(new)
        (k, kinds), (c, texts) = coded(t["_k"]), coded(t["_c"])
        names = texts.to_pylist()
        lab, sharp = colours.labs(names), np.array([x.startswith("#") for x in names], bool)
        own = chart * 2 + t["_side"].to_numpy()
        _, first = np.unique((own * len(kinds) + k) * len(names) + c, return_index=True)
        first = np.sort(first)  # a side's colours by their least place
        first = first[np.argsort(own[first], kind="stable")]
        n = np.bincount(own[first], minlength=2 * chart[-1] + 2)
        ends = np.cumsum(n)
        keep = np.ones(len(first), bool)
        for at in np.flatnonzero(n > most):
            here = np.arange(ends[at] - n[at], ends[at])
            keep[here] = np.isin(np.arange(len(here)), colours.unlike(c[first[here]], lab, sharp))
        first = first[keep]
        n = np.bincount(own[first], minlength=2 * chart[-1] + 2)
        block, wanted = chart[first] * len(kinds) + k[first], own[first] % 2 == 0
        g, p = first[wanted], first[~wanted]
        p = p[np.argsort(block[~wanted], kind="stable")]
        blocks = chart[p] * len(kinds) + k[p]
        low, high = (np.searchsorted(blocks, block[wanted], s) for s in ("left", "right"))
        i = np.repeat(np.arange(len(g)), high - low)
        j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        each, group = np.unique(block[wanted][i], return_inverse=True)
        totals = _totals(group, i, j, colours.likenesses(c[g[i]], c[p[j]], lab, sharp), len(each))
        total = np.bincount(each // len(kinds), totals, minlength=chart[-1] + 1)
        heads = t.select(keys).take(np.flatnonzero(new | (np.arange(len(t)) == 0))).combine_chunks()
        return pa.RecordBatch.from_arrays([*[heads[k].combine_chunks() for k in keys], pa.array(n[1::2], pa.int32()), pa.array(n[::2], pa.int32()), pa.array(total, pa.float64())], names=[*keys, "preds", "targets", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if len(cuts := np.flatnonzero(begins(t))):
                yield told(pa.concat_tables([*held, t.slice(0, cuts[-1])]))
                held = [t.slice(cuts[-1])]
            elif len(t):
                held.append(t)
        if held:
            yield told(pa.concat_tables(held))

    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("preds", T.IntegerType()), T.StructField("targets", T.IntegerType()), T.StructField("total", T.DoubleType())])
    precision, recall, f1 = rates(F.col("total"), F.col("preds"), F.col("targets"))
    return rows.mapInArrow(run, schema).select(*keys, "preds", "targets", "total", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def penalised(found: Column, targets: Column, preds: Column) -> Column:
    """Root of (what of the targets is found, as a share) x (1 - the error of their number, as a share, at least 0)."""
    off = F.greatest(F.lit(0.0), 1 - F.abs(preds - targets) / F.greatest(targets, F.lit(1)))
    return F.sqrt(F.coalesce(F.try_divide(found, targets), F.lit(0.0)) * off)


def interval_cluster(targets: Column, preds: Column) -> Column:
    """Score of two arrays of struct<start, end>: each target has its best overlap."""
    best = lambda t: F.coalesce(F.array_max(F.transform(preds, lambda p: time_iou(t["start"], t["end"], p["start"], p["end"]))), F.lit(0.0))
    return penalised(F.aggregate(targets, F.lit(0.0), lambda s, t: s + best(t)), F.size(targets), F.size(preds))


def box_cluster(targets: Column, preds: Column) -> Column:
    """Score of two arrays of boxes of one frame: overlaps are taken from the largest on, each box once; ties go by place."""
    corners = lambda b: F.struct(F.least(b["x1"], b["x2"]).alias("x1"), F.least(b["y1"], b["y2"]).alias("y1"), F.greatest(b["x1"], b["x2"]).alias("x2"), F.greatest(b["y1"], b["y2"]).alias("y2"))
    pairs = F.flatten(F.transform(targets, lambda t, i: F.transform(preds, lambda p, j: F.struct((-iou(corners(t), corners(p))).alias("s"), i.alias("i"), j.alias("j")))))
    free = lambda acc, x: ~F.array_contains(acc["i"], x["i"]) & ~F.array_contains(acc["j"], x["j"])
    more = lambda acc, x: F.struct(F.concat(acc["i"], F.array(x["i"])).alias("i"), F.concat(acc["j"], F.array(x["j"])).alias("j"), (acc["s"] - x["s"]).alias("s"))
    none = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"), F.lit(0.0).alias("s"))
    taken = F.aggregate(F.array_sort(pairs), none, lambda acc, x: F.when(free(acc, x), more(acc, x)).otherwise(acc), lambda acc: acc["s"])
    return penalised(taken, F.size(targets), F.size(preds))


def cluster_scores(targets: DataFrame, preds: DataFrame, keys: Sequence[str], cluster: str = "cluster", frame: str | None = None) -> DataFrame:
    """keys, clusters and score: clusters of unknown names matched at most total score, over the number of target clusters.

    Each side: keys, cluster, and start and end, or with ``frame`` x1, y1, x2, y2 of a box in a frame; a pair of clusters then
    scores its mean over the frames that either has. Rows without a cluster name are one cluster; keys without targets have no row.
    """
    keys, name = list(keys), F.struct(cluster)
    own = F.struct("start", "end") if frame is None else F.struct("x1", "y1", "x2", "y2")
    by = [] if frame is None else [F.col(frame).alias("_frame")]

    def side(df: DataFrame, n: str) -> DataFrame:
        lists = df.groupBy(*keys, name.alias(n), *by).agg(F.sort_array(F.collect_list(own)).alias("own"))
        entry = F.struct(F.lit(0).alias("f"), "own") if frame is None else F.struct(F.col("_frame").alias("f"), "own")
        return lists.groupBy(*keys, n).agg(F.collect_list(entry).alias(f"_{n}"))

    g, p = side(targets, "i"), side(preds, "j")
    pairs = g.join(p, keys)
    first = lambda frames: F.get(frames, F.lit(0))["own"]
    at = lambda frames, f: F.coalesce(F.get(F.filter(frames, lambda x: x["f"].eqNullSafe(f)), F.lit(0))["own"], F.slice(first(frames), 1, 0))
    score = interval_cluster if frame is None else box_cluster
    frames = F.array_union(F.col("_i")["f"], F.col("_j")["f"])
    mean = F.aggregate(frames, F.lit(0.0), lambda s, f: s + score(at(F.col("_i"), f), at(F.col("_j"), f))) / F.size(frames)
    total = best_total(pairs.select(*keys, F.to_json("i").alias("i"), F.to_json("j").alias("j"), mean.alias("score")), keys)
    return g.groupBy(*keys).agg(F.count("*").alias("clusters")).join(total, keys, "left").select(*keys, "clusters", (F.coalesce("total", F.lit(0.0)) / F.col("clusters")).alias("score"))
