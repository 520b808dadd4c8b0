"""Reports: one aggregation over grouping sets, in long form (kind, name, measures)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import ratio


def levels(df: DataFrame, kinds: Mapping[str, str | None], measures: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Measures over all rows and by each named column, in one pass.

    kinds: kind -> column, None for all rows. by: columns that every group also has (a split). The result has by, kind,
    name and the measures; a kind's name is 'Overall' where its column is None.
    """
    cols = list(dict.fromkeys(c for c in kinds.values() if c))
    sets = [[*by, *([c] if c else [])] for c in kinds.values()]
    if not cols and not by:
        return df.agg(*[m.alias(n) for n, m in measures.items()]).select(F.lit(next(iter(kinds))).alias("kind"), F.lit("Overall").alias("name"), *measures)
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, *cols)])
    out = grouped.agg(F.grouping_id().alias("__id"), *[m.alias(n) for n, m in measures.items()])
    width = len(by) + len(cols)

    def code(s: list[str]) -> int:
        return sum(1 << (width - 1 - k) for k, c in enumerate((*by, *cols)) if c not in s)

    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (k, c), s in zip(kinds.items(), sets, strict=True):
        here = F.col("__id") == code(s)
        kind = F.when(here, F.lit(k)).otherwise(kind)
        name = F.when(here, F.col(c).cast("string") if c else F.lit("Overall")).otherwise(name)
    return out.select(*by, kind.alias("kind"), name.alias("name"), *measures)


def percent(hit: Column) -> Column:
    return F.round(F.avg(hit.cast("double")) * 100, 6)


def confusion(truth: Column, pred: Column) -> dict[str, Column]:
    """Counts of a binary classifier; truth and pred are booleans."""
    return {"n": F.count(F.lit(1)), "tp": F.count_if(truth & pred), "fp": F.count_if(~truth & pred), "fn": F.count_if(truth & ~pred), "tn": F.count_if(~truth & ~pred)}


def prf(df: DataFrame, scale: float = 100.0) -> DataFrame:
    """Adds accuracy, precision, recall and f1 to confusion counts; 0 where a denominator is."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rounded = lambda c: F.round(c * scale, 6)
    return df.withColumns({"acc": rounded(ratio(F.col("tp") + F.col("tn"), F.col("n"))), "precision": rounded(p), "recall": rounded(r), "f1": rounded(ratio(2 * p * r, p + r))})


def mean_of_means(df: DataFrame, value: Column, inner: Sequence[str], outer: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean, by outer, of the means by inner."""
    each = df.groupBy(*outer, *inner).agg(F.avg(value).alias("__mean"))
    return each.groupBy(*outer).agg(F.avg("__mean").alias("mean"), F.count(F.lit(1)).alias("groups"))


def pivot_report(df: DataFrame, row: str, column: str, values: Sequence[str], value: Column, fill: float = 0.0) -> DataFrame:
    """Means by row and column, wide, absent cells filled, and Avg: the mean of a row's cells."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.avg(value)).na.fill(fill)
    total = reduce(lambda a, c: a + c, [F.col(f"`{v}`") for v in values])
    return wide.withColumn("Avg", total / len(values))


def weighted_accuracy(weight: Column, hit: Column) -> Column:
    return ratio(F.sum(weight * hit.cast("double")), F.sum(weight))


def valid_mean(score: Column) -> Column:
    """Mean of the scores that are not negative (negative: the judge failed)."""
    return F.avg(F.when(score >= 0, score))


def ratio_of_means(a: Column, b: Column) -> Column:
    return F.try_divide(F.avg(a), F.avg(b))


def multi_valued(df: DataFrame, values: Column, value: Column, name: str = "skill") -> DataFrame:
    """n, hits and rate of every value of an array column, and of 'Overall'."""
    each = df.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("Overall")), values))).alias(name), value.cast("double").alias("__v"))
    return each.groupBy(name).agg(F.count(F.lit(1)).alias("tot"), F.sum("__v").alias("hit"), F.round(F.avg("__v") * 100, 6).alias("rate"))


def field_task_report(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fields: task, query, field, weight, score. Queries' scores are weighted means of their valid fields (a negative
    score is invalid; a query of invalid fields alone has -1 and adds 0 to its task). Returns by task: mean, n; and
    macro (mean of tasks) and micro (mean of queries)."""
    ok = F.col("score") >= 0
    q = fields.groupBy("task", "query").agg(ratio(F.sum(F.when(ok, F.col("score") * F.col("weight"))), F.sum(F.when(ok, F.col("weight"))), -1.0).alias("s"))
    tasks = q.groupBy("task").agg(F.avg(F.greatest("s", F.lit(0.0))).alias("mean"), F.count(F.lit(1)).alias("n"))
    both = tasks.agg(F.avg("mean").alias("macro"), ratio(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("micro"))
    return tasks, both


def min_fields(fields: DataFrame) -> DataFrame:
    """The other way to join fields: a query's score is its least valid one."""
    return fields.groupBy("task", "query").agg(F.coalesce(F.min(F.when(F.col("score") >= 0, F.col("score"))), F.lit(-1.0)).alias("s"))


def pairwise(df: DataFrame, verdict: Column, swapped: Column) -> DataFrame:
    """Counts of the five verdicts from the first model's side, reward and win rate. verdict: A>>B, A>B, A=B, B>A, B>>A; swapped rows count with the sign turned."""
    value = F.create_map(*[F.lit(x) for kv in {"A>>B": 2, "A>B": 1, "A=B": 0, "B>A": -1, "B>>A": -2}.items() for x in kv])[verdict]
    s = df.select(F.when(swapped, -value).otherwise(value).alias("s"))
    names = {"much_better": 2, "better": 1, "tie": 0, "worse": -1, "much_worse": -2}
    n = F.count("s")
    return s.agg(n.alias("n"), *[F.count_if(F.col("s") == v).alias(k) for k, v in names.items()], F.round(ratio(F.sum("s"), n) * 50, 6).alias("reward"), F.round(ratio(F.count_if(F.col("s") > 0), n) * 100, 6).alias("win_rate"))


def control_groups(df: DataFrame, group: str, control: str) -> DataFrame:
    """Each group's rows and those of the shared control group; then the control group itself is no group of its own."""
    others = df.where(F.col(group) != control)
    shared = df.where(F.col(group) == control).drop(group).crossJoin(F.broadcast(others.select(group).distinct()))
    return others.unionByName(shared.select(*df.columns))


def right_closed_bin(c: Column, edges: Sequence[float]) -> Column:
    """Name of the bin (a, b] that holds a value; null outside."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        out = F.when((c > a) & (c <= b), F.lit(f"({a:g},{b:g}]")).otherwise(out)
    return out
