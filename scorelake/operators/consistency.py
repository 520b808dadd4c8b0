"""Group consistency: everything right in a group, pairs, cells, cycles, worst cases, step chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def all_right(df: DataFrame, keys: Sequence[str], hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of groups in which every row is a hit, by ``by``."""
    each = df.groupBy(*by, *keys).agg(F.bool_and(hit).alias("__all"))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.round(F.avg(F.col("__all").cast("double")) * 100, 6).alias("acc"))


def number_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "k") -> DataFrame:
    """Place of each row in its group, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def pairs(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 2) -> DataFrame:
    """Consecutive rows of a group, ``size`` at a time, get the same number ``pair``."""
    return number_in(df, keys, order).withColumn("pair", F.floor(F.col("k") / size)).drop("k")


def first_two(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Per group with two rows or more: v0 and v1, the values of the first two."""
    k = number_in(df.withColumn("__v", value), keys, order).where("k < 2")
    return k.groupBy(*keys).agg(F.max(F.when(F.col("k") == 0, F.col("__v"))).alias("v0"), F.max(F.when(F.col("k") == 1, F.col("__v"))).alias("v1")).where("v0 is not null and v1 is not null")


def pair_accuracy(df: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Share of groups with at least two rows, all hits; a single row counts as wrong."""
    each = df.groupBy(*keys).agg((F.bool_and(hit) & (F.count(F.lit(1)) >= 2)).alias("ok"))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.avg(F.col("ok").cast("double")).alias("acc"))


def circular(df: DataFrame, group: str, pred: Column, truth: Column) -> DataFrame:
    """hit per group: all rotations are answered rightly; n is the number of rotations."""
    return df.groupBy(group).agg(F.bool_and(pred == truth).cast("int").alias("hit"), F.count(F.lit(1)).alias("n"))


def four_cells(df: DataFrame, group: str, cell: str, hit: str) -> DataFrame:
    """Of groups with cells 0..3 (question * 2 + image): shares of right questions (both images), images (both questions), groups (all), and cells."""
    h = [F.max(F.when(F.col(cell) == k, F.col(hit).cast("int"))).alias(f"h{k}") for k in range(4)]
    g = df.groupBy(group).agg(*h).where("h0 is not null and h1 is not null and h2 is not null and h3 is not null")
    return g.agg(
        F.count(F.lit(1)).alias("groups"),
        F.round(F.avg((F.col("h0") * F.col("h1") + F.col("h2") * F.col("h3")) / 2.0) * 100, 6).alias("q_acc"),
        F.round(F.avg((F.col("h0") * F.col("h2") + F.col("h1") * F.col("h3")) / 2.0) * 100, 6).alias("i_acc"),
        F.round(F.avg((F.col("h0") * F.col("h1") * F.col("h2") * F.col("h3")).cast("double")) * 100, 6).alias("g_acc"),
        F.round(F.avg((F.col("h0") + F.col("h1") + F.col("h2") + F.col("h3")) / 4.0) * 100, 6).alias("acc"),
    )


def rotations(df: DataFrame, keys: Sequence[str], rotation: str, hit: str, values: Sequence) -> DataFrame:
    """Rows that have every rotation: one column per rotation, hit_all and miss_all."""
    wide = df.groupBy(*keys).pivot(rotation, list(values)).agg(F.max(F.col(hit).cast("int")))
    cols = [F.col(f"`{v}`") for v in values]
    whole = wide
    for c in cols:
        whole = whole.where(c.isNotNull())
    return whole.withColumns({"hit_all": F.least(*cols), "miss_all": 1 - F.greatest(*cols)})


def worst_case(df: DataFrame, key: str, hit: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean over rows, and mean over keys of the least hit among a key's variants."""
    each = df.groupBy(*by, key).agg(F.min(hit.cast("int")).alias("worst"), F.sum(hit.cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.round(F.sum("s") / F.sum("n") * 100, 6).alias("average"), F.round(F.avg("worst") * 100, 6).alias("worst_case"))


def step_chain(steps: DataFrame, multi: DataFrame, key: str = "id") -> DataFrame:
    """Left-joins single steps (id, hit_1, hit_2) to the composed problem (id, hit) and sorts each id into one of four
    states: CM (composed and all steps right), IG (composed wrong, steps right), IK (composed wrong, a step wrong),
    RM (composed right, every step wrong; loosely: any step wrong)."""
    j = multi.join(steps, key, "left").na.fill(False, ["hit_1", "hit_2"])
    one, two, whole = F.col("hit_1"), F.col("hit_2"), F.col("hit")
    return j.select(key, (whole & one & two).alias("cm_strict"), (whole & (one | two)).alias("cm_loose"), (~whole & one & two).alias("ig"), (~whole & ~(one & two)).alias("ik"), (whole & ~(one & two)).alias("rm_strict"), (whole & ~one & ~two).alias("rm_loose"))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that have no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def last_wins(results: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the latest."""
    rest = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def missing(rows: DataFrame, columns: DataFrame, present: DataFrame) -> DataFrame:
    """Combinations of two small sets that do not occur."""
    every = rows.crossJoin(columns)
    return every.join(present.select(*every.columns).distinct(), every.columns, "left_anti")


def majority(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group; ties go to the one that came first."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at"))
    return n.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(value))
