"""Orders of elements: edit distance and displacement of arrays, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: More than any distance.
_FAR = 1 << 29


def _let(value: Column, f) -> Column:
    """f of value, which is worked out once: inside a lambda an expression is worked out anew wherever it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def array_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of any one type; null where either is. Null elements equal null elements.

    The table is gone through by its diagonals, from corner to corner: a cell needs only cells of the two diagonals before its
    own, so a diagonal is one pass. A step holds two diagonals, each as long as a.
    """

    def filled(ab: Column) -> Column:
        x, y = ab["a"], ab["b"]
        n, m = F.size(x), F.size(y)

        def cell(s: Column, k: Column, i: Column) -> Column:
            j = k - i
            corner = F.get(s["before"], i - 1) + F.when(F.get(x, i - 1).eqNullSafe(F.get(y, j - 1)), 0).otherwise(1)
            inner = F.least(F.get(s["last"], i - 1) + 1, F.get(s["last"], i) + 1, corner)
            return F.when((j < 0) | (j > m), _FAR).when(i == 0, j).when(j == 0, i).otherwise(inner)

        def step(s: Column, k: Column) -> Column:
            return F.struct(s["last"].alias("before"), F.transform(s["last"], lambda _, i: cell(s, k, i)).alias("last"))

        start = F.struct(F.array_repeat(F.lit(_FAR), n + 1).alias("before"), F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, 0).otherwise(_FAR)).alias("last"))
        return F.when(n + m == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), n + m), start, step, lambda s: F.element_at(s["last"], -1)))

    return F.when(a.isNotNull() & b.isNotNull(), _let(F.struct(a.alias("a"), b.alias("b")), filled))


def order_edit(gt: Column, pred: Column) -> Column:
    """Edit distance over the longer length; null where both are empty, as such pages are left out."""
    longer = F.greatest(F.size(gt), F.size(pred))
    return F.when(longer > 0, array_edit_distance(gt, pred) / longer)


def move_distance(gt: Column, pred: Column) -> Column:
    """Displacement of a permutation, over its length: going through gt, an element that pred has not at that place costs the
    distance to where pred has it first; if that is further ahead, both places of pred change their elements, else
    pred stays. Null where the lengths differ, where pred lacks an element, or for empty orders."""

    def moved(both: Column) -> Column:
        want_all, n = both["gt"], F.size(both["gt"])

        def turned(own: Column, at: Column, i: Column) -> Column:
            """own with the elements of two places exchanged, at before i."""
            cut = lambda lo, hi: F.slice(own, lo + 1, hi - lo)
            return F.concat(cut(F.lit(0), at), F.array(F.get(own, i)), cut(at + 1, i), F.array(F.get(own, at)), cut(i + 1, n))

        def step(s: Column, i: Column) -> Column:
            want, have = F.get(want_all, i), F.get(s["own"], i)

            def go(at: Column) -> Column:
                after = F.struct(F.when((at >= 0) & (at < i), turned(s["own"], at, i)).otherwise(s["own"]).alias("own"), (s["cost"] + F.abs(at - i)).alias("cost"))
                return F.when(at >= 0, after).otherwise(F.struct(s["own"].alias("own"), F.lit(None).cast("long").alias("cost")))

            return F.when(want == have, s).otherwise(_let((F.array_position(s["own"], want) - 1).cast("int"), go))

        begin = F.struct(both["pred"].alias("own"), F.lit(0).cast("long").alias("cost"))
        fits = (n == F.size(both["pred"])) & (n > 0)
        return F.when(fits, F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), begin, step, lambda s: s["cost"]) / n)

    return _let(F.struct(gt.alias("gt"), pred.alias("pred")), moved)
