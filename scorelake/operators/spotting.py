"""Spotted words: polygons with a text against polygons with a text, matched one to one, and the report on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry
from .shared import discard, written

#: A text that marks a region which counts neither for nor against.
IGNORED = "###"
#: Marks that a target's text may have at either end and a spotted one lack.
MARKS = "!?.:,*\"()·[]/'"


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], left: str, right: str, cell: float) -> DataFrame:
    """Pairs of rows whose polygons' boxes touch, by a grid: a box stands in each cell that it touches, and a pair is taken
    in the one cell that holds the corner where both boxes have begun. Null and empty polygons touch nothing."""

    def celled(df: DataFrame, polygon: str, at: str) -> DataFrame:
        place = lambda c: F.floor(F.col(f"{at}.{c}") / cell)
        cells = lambda lo, hi: F.explode(F.sequence(place(lo), place(hi)))
        return df.where(F.size(polygon) > 0).withColumn(at, geometry.bounds(F.col(polygon))).withColumn("__x", cells("x1", "x2")).withColumn("__y", cells("y1", "y2"))

    pairs = celled(a, left, "__a").join(celled(b, right, "__b"), [*keys, "__x", "__y"])
    first = lambda c: F.greatest(f"__a.{c}1", f"__b.{c}1")
    here = (F.floor(first("x") / cell) == F.col("__x")) & (F.floor(first("y") / cell) == F.col("__y"))
    touch = (first("x") <= F.least("__a.x2", "__b.x2")) & (first("y") <= F.least("__a.y2", "__b.y2"))
    return pairs.where(here & touch).drop("__x", "__y", "__a", "__b")


#: Groups of so many pairs at most are gone through pair by pair.
FEW = 64


def first_come(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    """One-to-one pairs as if they were taken in the order of left, then right, each if both its sides are still free.

    The sorted pairs of a small group are gone through as one array. Larger groups go in rounds: a round takes every pair
    that is the first for its left and for its right, and drops all others of those; after as many rounds as the longest
    chain of pairs that wait for each other, none is left.
    """
    rest = written(pairs)
    large = written(rest.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > FEW).select(*keys))
    out = _one_by_one(rest.join(large, [*keys], "left_anti"), keys, left, right)
    return out if large.isEmpty() else out.unionByName(_in_rounds(written(rest.join(large, [*keys], "left_semi")), keys, left, right))


def _one_by_one(pairs: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    others = [c for c in pairs.columns if c not in (*keys, left, right)]
    listed = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(left, right, *others))).alias("__all"))
    taken = F.filter("__all", lambda _: F.lit(False))

    def step(own: Column, p: Column) -> Column:
        return F.when(F.exists(own, lambda q: (q[left] == p[left]) | (q[right] == p[right])), own).otherwise(F.array_append(own, p))

    return listed.select(*keys, F.inline(F.aggregate("__all", taken, step))).select(*pairs.columns)


def _in_rounds(rest: DataFrame, keys: Sequence[str], left: str, right: str) -> DataFrame:
    order, columns, found = F.struct(left, right), rest.columns, []
    while not rest.isEmpty():
        one = rest.groupBy(*keys, left).agg(F.min(order).alias("__one"))
        two = rest.groupBy(*keys, right).agg(F.min(order).alias("__two"))
        taken = written(rest.join(one, [*keys, left]).join(two, [*keys, right]).where((F.col("__one") == order) & (F.col("__two") == order)).select(*columns))
        free = rest.join(taken.select(*keys, left), [*keys, left], "left_anti").join(taken.select(*keys, right), [*keys, right], "left_anti")
        found.append(taken)
        rest, last = written(free.select(*columns)), rest
        discard(last)
    out = rest
    for taken in found:
        out = out.unionByName(taken)
    return out


def same_text(target: Column, spotted: Column) -> Column:
    """Equality without case; the target may have one mark more at its beginning, its end, or both."""
    t, s = F.upper(target), F.upper(spotted)
    mark = lambda c: F.contains(F.lit(MARKS), c) & (F.length(c) == 1)
    first, last = mark(F.left(t, F.lit(1))), mark(F.right(t, F.lit(1)))
    n = F.length(t)
    inner = F.substr(t, F.lit(2), F.greatest(n - 2, F.lit(0)))
    return (t == s) | (first & (F.substr(t, F.lit(2)) == s)) | (last & (F.left(t, n - 1) == s)) | (first & last & (n > 1) & (inner == s))


def spotting(targets: DataFrame, spotted: DataFrame, keys: Sequence[str], least: float = 0.5, cell: float = 64.0) -> DataFrame:
    """keys, targets, spotted, matched, correct: numbers of each image.

    targets: keys, g (order), polygon (convex), text; spotted: keys, d (order), polygon, text. Targets marked IGNORED do not
    count, nor does what lies by more than half inside one. A target and a spotted polygon match if the area they share is more
    than ``least`` of what both cover, first come, first served; a match is correct if the texts are the same.
    """
    area = geometry.polygon_area(F.col("polygon"))  # once a polygon, not once a pair
    t = targets.select(*keys, "g", F.col("polygon").alias("one"), F.col("text").alias("target"), area.alias("own"))
    s = spotted.select(*keys, "d", F.col("polygon").alias("two"), F.col("text").alias("read"), area.alias("other"))
    ignored = F.coalesce(F.col("target") == IGNORED, F.lit(False))
    shared = geometry.shared_area(F.col("two"), F.col("one"))
    pairs = written(overlapping(t, s, keys, "one", "two", cell).select(*keys, "g", "d", "target", "read", ignored.alias("ignored"), shared.alias("shared"), "own", "other"))
    share = lambda of: F.round(F.try_divide(F.col("shared"), F.col(of)), 9)  # noqa: E731  (rounded, so that an exact half is one whichever way it was worked out)
    inside = pairs.where(F.col("ignored") & (share("other") > 0.5)).select(*keys, "d").distinct()
    near = pairs.where(~F.col("ignored") & (F.round(F.try_divide(F.col("shared"), F.col("own") + F.col("other") - F.col("shared")), 9) > least))
    near = near.join(inside, [*keys, "d"], "left_anti").select(*keys, "g", "d", F.coalesce(same_text(F.col("target"), F.col("read")), F.lit(False)).alias("right"))
    match = first_come(near, keys, "g", "d")
    known = F.lit(True)
    for k in keys:  # a null key names no image: one row, and nothing counts
        known = known & F.col(k).isNotNull()
    names = ("targets", "spotted", "matched", "correct")
    count = lambda df, *on: df.select(*keys, *[(known & c).cast("long").alias(c_) for c, c_ in zip(on, names, strict=True)])
    no, yes = F.lit(False), F.lit(True)
    counted = s.join(inside.withColumn("__in", yes), [*keys, "d"], "left")
    rows = count(t, ~ignored, no, no, no).unionByName(count(counted, no, F.col("__in").isNull(), no, no)).unionByName(count(match, no, no, yes, F.col("right")))
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def rates(targets: Column, spotted: Column, correct: Column) -> tuple[Column, Column, Column]:
    """Recall, precision and their harmonic mean. Without targets recall is 1, and precision 1 if nothing was spotted."""
    recall = F.when(targets == 0, 1.0).otherwise(correct / targets)
    precision = F.when(targets == 0, F.when(spotted == 0, 1.0).otherwise(0.0)).when(spotted == 0, 0.0).otherwise(correct / spotted)
    return recall, precision, F.when(recall + precision == 0, 0.0).otherwise(2 * recall * precision / (recall + precision))
