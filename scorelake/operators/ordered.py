"""Ordered analytics over windows: smoothing, filling, islands, tail repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written


def smooth(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Where a segment overlaps the next, both meet at the middle of the overlap. Both sides read the times as given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before, after = F.lag(end).over(w), F.lead(start).over(w)
    new_start = F.when(before > F.col(start), (before + F.col(start)) / 2).otherwise(F.col(start))
    new_end = F.when(F.col(end) > after, (F.col(end) + after) / 2).otherwise(F.col(end))
    return df.withColumns({f"new_{start}": new_start, f"new_{end}": new_end})


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Zeros take the last non-zero value before them; leading zeros stay."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("filled", F.coalesce(F.last(F.nullif(F.col(value), F.lit(0.0)), ignorenulls=True).over(w), F.lit(0.0)))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: str) -> DataFrame:
    """Numbers runs of rows with the same value, from 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((F.lag(same).over(w) != F.col(same)).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def ordered_concat(order: Sequence[str], text: str, sep: str = " ") -> Column:
    """Aggregate: the texts of a group in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), sep)


def history(df: DataFrame, keys: Sequence[str], order: Sequence[str], speaker: str, text: str) -> DataFrame:
    """One row per island of a speaker with its texts joined."""
    i = islands(df, keys, order, speaker)
    return i.groupBy(*keys, "island", speaker).agg(ordered_concat(order, text).alias(text), F.count(F.lit(1)).alias("n"))


def boundaries(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("boundary", F.coalesce(F.lag(label).over(w) != F.col(label), F.lit(False)))


def rising(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, weights: Sequence[float]) -> DataFrame:
    """The value, raised to the weighted start marks of the next rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ahead = [F.coalesce(F.lead(start, k).over(w), F.lit(0.0)) * v for k, v in enumerate(weights, 1)]
    return df.withColumn("soft", F.greatest(F.col(start), *ahead))


def tail_repeats(text: Column, most: int) -> Column:
    """For n = 1..most, how often the text's last n characters stand at its end, back to back; runs of white space count as
    one space; 0 where the text is shorter than n. Read from the end, so each n is one pass."""
    back = F.reverse(F.regexp_replace(text, r"(?U)\s+", " "))
    run = lambda n: F.floor(F.length(F.regexp_extract(back, rf"(?s)\A(.{{{n}}})\1*+", 0)) / n).cast("int")
    return F.array(*[run(n) for n in range(1, most + 1)])


def speaker_top1(df: DataFrame, keys: Sequence[str], speaker: str, score: str, threshold: float) -> DataFrame:
    """Who speaks: the highest score above the threshold; ties go to the smaller id; nobody gives no row."""
    active = df.where(F.col(score) > threshold)
    return active.groupBy(*keys).agg(F.max_by(F.col(speaker), F.struct(F.col(score), -F.col(speaker))).alias(speaker), F.max(score).alias(score))


def dense_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Numbers all rows from 0 in the given order. Rows are dealt to ranges, numbered within, and shifted by the counts of
    the ranges before; only one count a range goes through a window of its own, so no task holds all rows.

    The dealt rows are a table of their own, as ranges drawn twice need not be the same."""
    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    first = ranged.groupBy("__part").agg(F.count("*").alias("n")).select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    numbered = ranged.withColumn("__within", within).join(F.broadcast(first), "__part")
    return numbered.withColumn(name, (F.col("__within") + F.col("__first")).cast("long")).drop("__part", "__within", "__first")
