"""Named ratings: small compositions of the report and consistency operators over a score table.

A score table has one row per answer with a numeric or boolean score and the columns that its rating groups by.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import ratio
from . import consistency, report


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def blocks_of(df: DataFrame, order: Sequence[str], size: int, hit: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Share of runs of ``size`` consecutive rows in which all are hits, by keys; and the plain accuracy."""
    each = consistency.pairs(df.withColumn("__hit", hit), keys, order, size).groupBy(*keys, "pair").agg(F.bool_and("__hit").alias("all"), F.avg(F.col("__hit").cast("double")).alias("avg"))
    return each.groupBy(*keys).agg(F.avg(F.col("all").cast("double")).alias("overall"), F.avg("avg").alias("average"))


def roll_up(df: DataFrame, path: Sequence[str], hit: Column) -> DataFrame:
    """Micro accuracy at every level of a path, e.g. task, subtask, category, and overall: one rollup."""
    r = df.rollup(*path).agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("hits"))
    return r.withColumn("acc", ratio(F.col("hits"), F.col("n")))


def remapped_macro(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]], value: Column, digits: int = 2) -> DataFrame:
    """Member means, means of each named group of members (absent ones skipped), and the mean of the groups."""
    m = df.groupBy(F.col(column).alias("name")).agg(F.avg(value).alias("score"))
    of = F.create_map(*[F.lit(x) for g, members in groups.items() for k in members for x in (k, g)])
    g = m.withColumn("name", of[F.col("name")]).where("name is not null").groupBy("name").agg(F.avg("score").alias("score"))
    total = g.agg(F.avg("score").alias("score")).select(F.lit("Overall").alias("name"), "score")
    return _union([m, g, total]).withColumn("score", F.round("score", digits))


def super_sums(df: DataFrame, column: str, groups: Mapping[str, Sequence[str]], value: Column) -> DataFrame:
    """Sums of values over named groups of categories, and of all."""
    m = df.groupBy(column).agg(F.sum(value).alias("s"))
    return m.agg(*[F.coalesce(F.sum(F.when(F.col(column).isin(list(k)), F.col("s"))), F.lit(0)).alias(g) for g, k in groups.items()], F.sum("s").alias("total"))


def ordered_splits(df: DataFrame, split: str, order: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Measures by split in a fixed order, other splits after them by name, and the unweighted Average."""
    m = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in measures.items()])
    place = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    rows = m.withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1))
    average = m.agg(F.sum("n").alias("n"), *[F.avg(k).alias(k) for k in measures]).select(F.lit("Average").alias(split), "n", *measures, F.lit(len(order) + 2).cast("long").alias("place"))
    return rows.unionByName(average).orderBy("place", split).drop("place")


def repeated_key_mean(df: DataFrame, keys: Sequence[Column], hit: Column) -> DataFrame:
    """Mean by key where every key's rows count as often as the key has rows (weights n per row, n**2 per key)."""
    long = df.select(F.explode(F.array_distinct(F.array(*keys))).alias("key"), hit.cast("double").alias("h"))
    each = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("acc"))
    return each.select("key", "n", "acc", (F.col("n") * F.col("n")).alias("weight"))


def count_errors(df: DataFrame) -> DataFrame:
    """Accuracy, off-by-one accuracy, mean absolute and root mean square error of pred and truth."""
    d = F.abs(F.col("pred") - F.col("truth"))
    return df.agg(F.bround(F.avg((d == 0).cast("double")), 4).alias("acc"), F.bround(F.avg((d <= 1).cast("double")), 4).alias("oboa"), F.bround(F.avg(d), 4).alias("mae"), F.bround(F.sqrt(F.avg(d * d)), 4).alias("rmse"))


def count_penalty(pred: Column, truth: Column, length: Column, longest: Column) -> Column:
    """1 - (relative error)**(1/10) scaled by longest / length; 1 if right."""
    rel = F.least(F.abs(pred - truth) / F.greatest(truth, F.lit(1)), F.lit(1.0))
    return F.when(pred == truth, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - longest / length * F.pow(rel, F.lit(0.1))))


def attempted(df: DataFrame, verdict: str) -> DataFrame:
    """Verdicts 'correct', 'incorrect', 'not_attempted': shares, accuracy of attempts, and F1 of both."""
    n = F.count(F.lit(1))
    share = lambda v: ratio(F.count_if(F.col(verdict) == v), n)
    s = df.agg(share("correct").alias("correct"), share("incorrect").alias("incorrect"), share("not_attempted").alias("not_attempted"))
    given = ratio(F.col("correct"), F.col("correct") + F.col("incorrect"))
    return s.withColumns({"accuracy_given_attempted": given, "f1": ratio(2 * given * F.col("correct"), given + F.col("correct"))})


def precision_recall_events(df: DataFrame, covered: str, said: str) -> DataFrame:
    """Means of per-row recall (share of ``covered`` true) and precision (of ``said``), empty lists counting 1; F1 of the two means."""
    mean = lambda c: F.avg(ratio(F.size(F.filter(c, lambda x: x)), F.size(c), 1.0))
    s = df.agg(mean(F.col(covered)).alias("recall"), mean(F.col(said)).alias("precision"))
    return s.withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def page_edit(df: DataFrame, page: str, edits: str, length: str, attribute: str | None = None) -> DataFrame:
    """Edits over length within a page, then the mean of pages, by attribute."""
    by = [attribute] if attribute else []
    each = df.groupBy(page, *by).agg(ratio(F.sum(edits), F.sum(length)).alias("r"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("pages"), F.avg("r").alias("edit"))


def slices(df: DataFrame, conditions: Mapping[str, Column], value: Column) -> DataFrame:
    """Mean and count of the rows that meet each named condition; rows may meet several. One pass."""
    a = df.agg(*[F.avg(F.when(c, value)).alias(f"m{k}") for k, c in enumerate(conditions.values())], *[F.count_if(c).alias(f"n{k}") for k, c in enumerate(conditions.values())])
    return a.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m{k}").alias("score"), F.col(f"n{k}").alias("n")) for k, n in enumerate(conditions)])).alias("s")).select("s.*")


def answerable_f1(df: DataFrame, score: Column, truth: Column, pred: Column, none: str = "Not answerable") -> DataFrame:
    """Recall over questions with an answer, precision over predictions with one, and F1."""
    r, p = F.avg(F.when(truth != none, score)), F.avg(F.when(pred != none, score))
    return df.agg(F.coalesce(r, F.lit(0.0)).alias("recall"), F.coalesce(p, F.lit(0.0)).alias("precision")).withColumn("f1", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))


def class_f1(df: DataFrame, truth: Column, pred: Column) -> DataFrame:
    """F1 of the positive and the negative class, and their mean weighted by the other class's share."""
    c = df.agg(*[v.alias(k) for k, v in report.confusion(truth, pred).items()])
    f = lambda tp: ratio(2 * F.col(tp), 2 * F.col(tp) + F.col("fp") + F.col("fn"))
    pos = ratio(F.col("tp") + F.col("fn"), F.col("n"))
    return c.select("n", f("tp").alias("f1_pos"), f("tn").alias("f1_neg"), (f("tp") * (1 - pos) + f("tn") * pos).alias("weighted"))


def masked_confusion(df: DataFrame, pred: str, label: str, mask: int = -100) -> DataFrame:
    """Token labels (arrays): predictions stand one place before their labels; masked labels do not count."""
    z = df.select(F.explode(F.arrays_zip(F.slice(pred, F.lit(1), F.greatest(F.size(pred) - 1, F.lit(0))).alias("p"), F.slice(label, F.lit(2), F.greatest(F.size(label) - 1, F.lit(0))).alias("l"))).alias("z")).select("z.p", "z.l").where(F.col("l") != mask)
    return report.prf(z.agg(*[v.alias(k) for k, v in report.confusion(F.col("l") == 1, F.col("p") == 1).items()]), 1.0)


def running_rounded_sum(df: DataFrame, by: str, value: str, digits: int = 2) -> DataFrame:
    """Sum of values of at most two decimals, exactly: rounding after every addition then changes nothing."""
    return df.groupBy(by).agg(F.sum(F.col(value).cast(f"decimal(18,{digits})")).cast("double").alias("score"))


def gated(df: DataFrame, seen: Column, answered: Column, by: Sequence[str] = ()) -> DataFrame:
    """An answer counts only where the perception was right."""
    return df.groupBy(*by).agg(F.avg(seen.cast("double")).alias("perception"), F.avg((seen & answered).cast("double")).alias("answer"))


def recall_at(df: DataFrame, key: str, iou: str, score: str, thresholds: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.5)) -> DataFrame:
    """Mean over thresholds of the share of keys with IoU above it (recall), and with a right answer too (accuracy)."""
    t = df.select(key, F.col(iou).alias("i"), F.col(score).alias("s"), F.explode(F.array(*map(F.lit, thresholds))).alias("t"))
    each = t.groupBy("t").agg(F.avg((F.col("i") > F.col("t")).cast("double")).alias("rec"), F.avg(((F.col("i") > F.col("t")) & (F.col("s") == 1)).cast("double")).alias("acc"))
    return each.agg(F.avg("rec").alias("rec_iou"), F.avg("acc").alias("acc_iou"))


def clamped_means(df: DataFrame, dimensions: str, value: str) -> DataFrame:
    """By each value of an array of dimensions: mean with negatives as 0 (all), and without them (valid)."""
    e = df.select(F.explode(F.array_distinct(dimensions)).alias("dimension"), F.col(value).alias("v"))
    return e.groupBy("dimension").agg(F.avg(F.greatest("v", F.lit(0))).alias("all"), F.avg(F.when(F.col("v") >= 0, F.col("v"))).alias("valid"))


def repeats_pass(df: DataFrame, file: str, test: str, passed: Column) -> DataFrame:
    """A test passes if over half of its repeats do; rate by file, and the mean of files."""
    each = df.groupBy(file, test).agg((F.avg(passed.cast("double")) > 0.5).alias("ok")).groupBy(file).agg(F.avg(F.col("ok").cast("double")).alias("rate"))
    return each.unionByName(each.agg(F.avg("rate").alias("rate")).select(F.lit("mean").alias(file), "rate"))


def cider(df: DataFrame, key: str = "id", pred: str = "pred", targets: str = "targets", most: int = 4) -> DataFrame:
    """Consensus of captions: for n = 1..4 the mean cosine of tf-idf n-gram vectors of pred and each target, times 10.

    df: key, pred (array of words), targets (array of arrays). Document frequency counts keys whose targets have the gram.
    """
    from .generate import ngrams

    n_docs = F.broadcast(df.agg(F.count(F.lit(1)).cast("double").alias("docs")))
    out = []
    for n in range(1, most + 1):
        gram = lambda c: F.transform(ngrams(c, n), lambda g: F.array_join(g, " "))  # noqa: B023, E731
        t = df.select(key, F.posexplode(targets).alias("ref", "tokens")).select(key, "ref", F.explode(gram(F.col("tokens"))).alias("g")).groupBy(key, "ref", "g").agg(F.count(F.lit(1)).alias("tf"))
        p = df.select(key, F.explode(gram(F.col(pred))).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("tf"))
        frequency = t.groupBy("g").agg(F.countDistinct(key).alias("df"))
        idf = lambda d: d.join(frequency, "g", "left").crossJoin(n_docs).withColumn("w", F.col("tf") * F.log(F.col("docs") / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1))))  # noqa: B023, E731
        tw, pw = idf(t), idf(p).select(key, "g", F.col("w").alias("pw"))
        tn, pn = tw.groupBy(key, "ref").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn")), pw.groupBy(key).agg(F.sqrt(F.sum(F.col("pw") * F.col("pw"))).alias("pn"))
        dot = tw.join(pw, [key, "g"]).groupBy(key, "ref").agg(F.sum(F.least("pw", "w") * F.col("w")).alias("dot"))
        cos = tn.join(dot, [key, "ref"], "left").join(pn, key, "left").select(key, F.coalesce(ratio(F.col("dot"), F.col("tn") * F.col("pn")), F.lit(0.0)).alias("c"))
        out.append(cos.groupBy(key).agg((F.avg("c") * 10).alias("c")))
    return _union(out).groupBy(key).agg((F.sum("c") / most).alias("cider"))
