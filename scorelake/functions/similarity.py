"""Scores of a prediction against a target, as Column expressions. Arrays are compared by value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import number, strip, words


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def anls_distance(pred: Column, target: Column) -> Column:
    """Edit distance of the lower-cased, space-collapsed texts over the longer length of the texts as they are."""
    plain = lambda c: F.array_join(words(F.lower(c)), " ")
    return ratio(F.levenshtein(plain(pred), plain(target)), F.greatest(F.length(pred), F.length(target)))


def anls_similarity(pred: Column, target: Column, threshold: float = 0.5) -> Column:
    """1 - edit distance / longer length, 0 if it is not above the threshold."""
    s = 1 - ratio(F.levenshtein(pred, target), F.greatest(F.length(pred), F.length(target)))
    return F.when(s > threshold, s).otherwise(0.0)


def leave_one_out(pred: Column, targets: Column) -> Column:
    """For each target, min(1, how many of the others equal the prediction / 3)."""
    others = lambda i: F.size(F.filter(targets, lambda y, j: (j != i) & (y == pred)))
    return F.transform(targets, lambda x, i: F.least(F.lit(1.0), others(i) / 3.0))


def relaxed(pred: Column, target: Column, tolerance: float = 0.05) -> Column:
    """Numbers within a relative tolerance (n% counts as n / 100); else equal texts, whatever their case."""
    value = lambda c: F.when(c.endswith("%"), number(F.regexp_replace(c, "%+$", "")) / 100).otherwise(number(c))
    p, t = value(pred), value(target)
    near = F.try_divide(F.abs(p - t), F.abs(t)) <= tolerance
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), near).otherwise(F.lower(pred) == F.lower(target))


def mean_relative_accuracy(pred: Column, target: Column) -> Column:
    """Tenths: at how many of the thresholds .5, .55, ..., 1.45 the error over the target is under 1 - threshold.

    The target divides with its sign, so a negative one passes thresholds beyond 1, and the value may exceed 1; 0 if the
    target is 0 or either is null.
    """
    room = F.array(*[F.lit(1 - (0.5 + 0.05 * k)) for k in range(20)])
    error = F.try_divide(F.abs(pred - target), target)
    return F.coalesce(F.size(F.filter(room, lambda r: error < r)) / 10.0, F.lit(0.0))


def float_equal(pred: Column, target: Column, relative: float = 0.01) -> Column:
    """Equal within a relative tolerance to the target, a hundredth or a hundred times it."""
    return F.exists(F.array(target / 100, target, target * 100), lambda t: F.abs(pred - t) <= relative * F.greatest(F.abs(pred), F.abs(t)))


def relative_difference(pred: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(F.try_divide(pred - target, target)))


def squared_error(pred: Column, target: Column) -> Column:
    return (pred - target) * (pred - target)


def clipped_rmse(pred: Column, target: Column, most: float = 0.1) -> Column:
    return 1 - F.least(F.abs(pred - target), F.lit(most)) / most


def angle_rmse(pred: Column, target: Column, most: float = 10.0) -> Column:
    turn = F.pmod(F.abs(pred - target), F.lit(360.0))
    return 1 - F.least(turn, 360.0 - turn, F.lit(most)) / most


def positive_int_match(pred: Column, target: Column) -> Column:
    """1 for equal whole numbers, 0 for others and for what is no whole number; -1 if neither is above 0, which a mean leaves out."""
    whole = r"^[ \t]*[+-]?(0+(_0+)*|[1-9]\d*(_\d+)*)\s*\z"
    value = lambda c: F.when(c.rlike(whole), F.replace(strip(c), F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))
    p, t = value(pred), value(target)
    return F.when((p <= 0) & (t <= 0), -1.0).otherwise(F.coalesce(p == t, F.lit(False)).cast("double"))


def estimation_score(pred: Column, target: Column) -> Column:
    """Tenths: at how many of the thresholds .5, .55, ..., .95 the error over the target's size is under 1 - threshold."""
    room = F.array(*[F.lit(1 - (0.5 + 0.05 * k)) for k in range(10)])
    error = F.try_divide(F.abs(target - pred), F.abs(target))
    return F.coalesce(F.size(F.filter(room, lambda r: error < r)) * 0.1, F.lit(0.0))


def within(pred: Column, target: Column, absolute: float = 1e-3, relative: float = 1e-6) -> Column:
    return F.abs(pred - target) <= F.greatest(F.lit(absolute), relative * F.abs(target))


def exact(pred: Column, target: Column) -> Column:
    """1 for equal texts, as they stand. A target of one letter is met by a longer answer's leading letter: A, (A), A. x, Ax."""
    letter = F.regexp_extract(pred, r"^\(?([A-Za-z])", 1)
    lone = target.rlike(r"^\p{L}\z") & (F.length(pred) > 1) & (letter != "")
    return (F.when(lone, letter).otherwise(pred) == target).cast("double")


def exact_any_case(pred: Column, target: Column) -> Column:
    return exact(F.lower(pred), F.lower(target))


def simple_match(pred: Column, target: Column) -> Column:
    """exact() without spaces, line ends, tabs, hyphens, periods and case."""
    plain = lambda c: F.lower(F.translate(c, " -\n\t.", ""))
    return exact(plain(pred), plain(target))


def multi_reference(pred: Column, targets: Column) -> Column:
    """1 if the answer is a simple match of any target."""
    return F.exists(targets, lambda t: simple_match(pred, t) == 1).cast("double")


def set_equality(pred: Column, target: Column) -> Column:
    return (F.array_sort(F.array_distinct(pred)) == F.array_sort(F.array_distinct(target))).cast("double")


def jaccard(pred: Column, target: Column) -> Column:
    """Of sets; two empty sets have 1."""
    return ratio(F.size(F.array_intersect(pred, target)), F.size(F.array_union(pred, target)), 1.0)


def set_precision(pred: Column, target: Column) -> Column:
    """Share of the predicted set that is right; an empty one has 1."""
    return ratio(F.size(F.array_intersect(pred, target)), F.size(F.array_distinct(pred)), 1.0)


def sequence_equality(pred: Column, target: Column) -> Column:
    return (pred == target).cast("double")


def sequence_accuracy(pred: Column, target: Column) -> Column:
    """Share of the target's places with the same value; 0 if the lengths differ."""
    same = F.size(F.filter(F.zip_with(pred, target, lambda x, y: x.eqNullSafe(y)), lambda x: x))
    return F.when(F.size(pred) == F.size(target), ratio(same, F.size(target), 1.0)).otherwise(0.0)


def prefix_ratio(pred: Column, target: Column) -> Column:
    """Length of the longest common prefix over the target's length."""
    n = F.least(F.size(pred), F.size(target))
    first = F.array_position(F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n), lambda i: (F.get(pred, i) != F.get(target, i)).cast("int")), 1)
    return ratio(F.when(first > 0, first - 1).otherwise(n), F.size(target), 1.0)


def coordinate_similarity(pred: Column, target: Column) -> Column:
    """Mean of exp(-10 d / sqrt 2) over paired points (arrays of [x, y]); 0 if the numbers of points differ."""
    d = F.zip_with(pred, target, lambda p, t: F.exp(-10 * F.sqrt((p[0] - t[0]) * (p[0] - t[0]) + (p[1] - t[1]) * (p[1] - t[1])) / (2**0.5)))
    return F.when(F.size(pred) == F.size(target), ratio(F.aggregate(d, F.lit(0.0), lambda a, x: a + x), F.size(target), 1.0)).otherwise(0.0)


def bag_f1(pred: Column, target: Column) -> Column:
    """F1 of token lists in which every occurrence counts that the other list has at all."""
    from .geometry import _let  # which needs this module itself

    def told(v: Column) -> Column:
        shared = lambda side: F.size(F.filter(v[side], lambda x: F.array_contains(v["both"], x)))
        p, r = ratio(shared("p"), F.size(v["p"])), ratio(shared("t"), F.size(v["t"]))
        return _let(F.struct(p.alias("p"), r.alias("r")), lambda x: ratio(2 * x["p"] * x["r"], x["p"] + x["r"]))

    sides = F.struct(pred.alias("p"), target.alias("t"))
    return _let(sides, lambda v: _let(F.struct(v["p"].alias("p"), v["t"].alias("t"), F.array_intersect(v["p"], v["t"]).alias("both")), told))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    each = F.transform(F.array_intersect(a, b), lambda x: F.least(count(a, x), count(b, x)))
    return F.aggregate(each, F.lit(0), lambda acc, n: acc + n)


def partial_match(pred: Column, target: Column) -> Column:
    """Common words over the larger number of words."""
    p, t = F.array_distinct(words(F.lower(pred))), F.array_distinct(words(F.lower(target)))
    return ratio(F.size(F.array_intersect(p, t)), F.greatest(F.size(p), F.size(t)))


def _near(pred: Column, target: Column) -> Column:
    """1 - edit distance over the longer length, 0 if it is under a half; 1 for two empty texts."""
    near = 1 - ratio(F.levenshtein(pred, target), F.greatest(F.length(pred), F.length(target)))
    return F.when(near >= 0.5, near).otherwise(0.0)


def _line(c: Column) -> Column:
    return F.replace(strip(F.lower(c)), F.lit("\n"), F.lit(" "))


def short_or_anls(pred: Column, target: Column) -> Column:
    """A target under five words: 1 if the answer contains it, else how near both are, from a half on; longer targets have no score."""
    p, t = _line(pred), _line(target)
    return F.when(F.size(words(t)) < 5, F.when(p.contains(t), 1.0).otherwise(_near(p, t))).when(p.isNotNull() & t.isNotNull(), 0.0)


def short_or_anls_any(pred: Column, targets: Column) -> Column:
    """The best over several targets: those under five words count if contained, longer ones by how near both are."""
    p = _line(pred)

    def one(target: Column) -> Column:
        t = _line(target)
        return F.when(F.size(words(t)) < 5, p.contains(t).cast("double")).otherwise(_near(p, t))

    return F.coalesce(F.array_max(F.transform(targets, one)), F.lit(0.0))


def dict_equality(pred: Column, target: Column) -> Column:
    entries = lambda m: F.array_sort(F.map_entries(m))
    return (entries(pred) == entries(target)).cast("double")


def dict_precision(pred: Column, target: Column) -> Column:
    right = F.size(F.map_filter(pred, lambda k, v: target[k].eqNullSafe(v)))
    return ratio(right, F.size(pred), 1.0)


def dict_recall(pred: Column, target: Column) -> Column:
    """Share of the target's keys with the same value."""
    right = F.size(F.map_filter(target, lambda k, v: pred[k].eqNullSafe(v)))
    return ratio(right, F.size(target), 1.0)


def dict_jaccard(pred: Column, target: Column) -> Column:
    """Mean over the union of keys of the Jaccard similarity of the values (arrays); a key of one side only has 0."""
    each = F.map_zip_with(pred, target, lambda k, p, t: F.when(p.isNull() | t.isNull(), 0.0).otherwise(jaccard(p, t)))
    return ratio(F.aggregate(F.map_values(each), F.lit(0.0), lambda a, x: a + x), F.size(each), 1.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def hit(scores: Column, kind: str) -> Column:
    """Reduces the scores of one row: 'mean', 'max', or 'anls': 1 - the least distance, 0 if that is under .5."""
    if kind == "mean":
        return ratio(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x), F.size(scores))
    if kind == "max":
        return F.array_max(scores)
    s = 1 - F.array_min(scores)
    return F.when(s >= 0.5, s).otherwise(0.0)


def rating(c: Column) -> Column:
    """1 for a judge's 'Correct', 0 for 'Incorrect': the one that the text begins with, else 1 if only 'Correct' is in it. 0 without either."""
    right = c.startswith("Correct") | (c.contains("Correct") & ~c.contains("Incorrect"))
    return F.when(c.isNotNull(), right.cast("int"))
