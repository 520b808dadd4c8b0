"""Resampling and distribution statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import dense_index


PRIME = 2147483647
#: Parts that the replicates are cut into, each a task's work on one stratum.
PARTS = 16


def _scalar(total: int, part: int) -> int:
    """A deterministic draw, the same in any SQL engine, is a linear congruence of its parts: the state after one more."""
    return (total * 1103515245 + part * 12820163 + 12345) % PRIME


def _spread(parts: np.ndarray) -> np.ndarray:
    """What the last parts of draws add to the state: (state * 1103515245 + this) % PRIME."""
    return (parts.astype(np.int64) % PRIME * 12820163 + 12345) % PRIME


def _mix(total: np.ndarray) -> np.ndarray:
    """The state as a draw, before its modulus."""
    return (total >> 16) * 31 + total


def _mean(v: np.ndarray) -> float:
    """Mean of what is not null."""
    s = v.sum()
    if s == s:
        return s / len(v) if len(v) else np.nan
    held = v[~np.isnan(v)]
    return held.sum() / len(held) if len(held) else np.nan


def _replicated(df: DataFrame, stratum: str, order: str, columns: dict[str, Column], replicates: int, f, name: str) -> DataFrame:
    """replicate and a value (null for NaN) by f(rows of a stratum in order, replicates) for each stratum and part of the replicates."""
    size = -(-replicates // PARTS)
    parts = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // size))).alias("__part")
    rows = df.where(F.col(stratum).isNotNull()).select(F.col(stratum).alias("__stratum"), F.col(order).cast("long").alias("__order"), *[c.alias(k) for k, c in columns.items()], parts)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        at = range(key[1] * size, min((key[1] + 1) * size, replicates))
        return pd.DataFrame({"replicate": list(at), name: f(g.sort_values("__order", kind="stable"), at)})

    found = rows.groupBy("__stratum", "__part").applyInPandas(run, f"replicate int, {name} double")
    return found.withColumn(name, F.nanvl(name, F.lit(None)))


def bootstrap(df: DataFrame, stratum: str, order: str, value: str, replicates: int = 1000) -> DataFrame:
    """Mean over strata of the means of each replicate's draws (as many as a stratum has rows, with replacement), then
    the 2.5 and 97.5 percentiles over replicates.

    A replicate needs a stratum's values by place: each part of the replicates takes every stratum's values once as
    arrays, and gives one mean per replicate and stratum; no draw becomes a row.
    """

    def means(g: pd.DataFrame, at: range) -> list[float]:
        v, slot = g["v"].to_numpy(np.float64), _spread(np.arange(len(g)))
        start = _scalar(12345, int(g["__order"].iloc[0]))
        return [_mean(v[_mix((_scalar(start, k) * 1103515245 + slot) % PRIME) % len(v)]) for k in at]

    each = _replicated(df, stratum, order, {"v": F.col(value).cast("double")}, replicates, means, "m").groupBy("replicate").agg(F.avg("m").alias("mean"))
    return each.agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


def permutation(df: DataFrame, stratum: str, order: str, group: str, value: str, replicates: int = 10000) -> DataFrame:
    """p-value of the difference of means of two groups (group is boolean): the share of within-stratum relabellings
    whose absolute difference of mean-of-strata is at least the observed one.

    A relabelling gives the first group's name to the rows with the least draws, as many as it has. Each part of the
    replicates takes every stratum's values once as arrays, and gives one difference per replicate and stratum."""
    n_a = df.groupBy(stratum).agg(F.count_if(F.col(group)).alias("n_a"), F.count(F.lit(1)).alias("n")).where("n_a > 0 and n_a < n")
    base = df.join(n_a, stratum)
    seen = base.groupBy(stratum).agg((F.avg(F.when(F.col(group), F.col(value))) - F.avg(F.when(~F.col(group), F.col(value)))).alias("g")).agg(F.round(F.avg("g"), 9).alias("observed"))

    def gaps(g: pd.DataFrame, at: range) -> list[float]:
        v, last, n = g["v"].to_numpy(np.float64), _spread(g["__order"].to_numpy()), int(g["n_a"].iloc[0])
        place, out = np.arange(len(v)), []
        for k in at:
            draw = _mix((_scalar(12345, k) * 1103515245 + last) % PRIME) % PRIME
            order = np.argpartition(draw << 32 | place, n - 1)
            out.append(_mean(v[order[:n]]) - _mean(v[order[n:]]))
        return out

    each = _replicated(base, stratum, order, {"v": F.col(value).cast("double"), "n_a": F.col("n_a")}, replicates, gaps, "g")
    shuffled = each.groupBy("replicate").agg(F.round(F.avg("g"), 9).alias("d"))
    return shuffled.crossJoin(seen).agg(F.max("observed").alias("observed"), F.round(F.avg((F.abs("d") >= F.abs("observed")).cast("double")), 6).alias("p"))


def moments(df: DataFrame, vector: str, by: Sequence[str] = (), groups: int = 64) -> DataFrame:
    """Mean vector and covariance matrix (sample) of array columns: by, i, j, n, mean (of i), cov. Null vectors are left out.

    A task adds up its vectors and their outer products, for at most ``groups`` groups at a time, and gives out one row a
    group; only these sums are shuffled. Vectors of unlike length in a group are added up apart.
    """
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(*by, F.size(vector).alias("__d"), F.col(vector).cast("array<double>").alias("__v"))
    keys = [*by, "__d"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def given() -> pd.DataFrame:
            out = pd.DataFrame([(*k, n, s, p.ravel()) for k, (n, s, p) in held.items()], columns=[*keys, "__n", "__s", "__p"])
            held.clear()
            return out

        for b in batches:
            for key, g in b.groupby(keys, dropna=False, sort=False):
                x = np.stack(g["__v"].to_numpy())
                n, s, p = held.get(key, (0, 0.0, 0.0))
                held[key] = [n + len(x), s + x.sum(axis=0), p + x.T @ x]
            if len(held) > groups:
                yield given()
        yield given()

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])
    e = rows.mapInPandas(sums, kinds + "__n long, __s array<double>, __p array<double>").select(*keys, "__n", "__s", F.posexplode("__p").alias("__k", "__xy"))
    at = lambda i: F.get("__s", i.cast("int"))
    k, d = F.col("__k"), F.col("__d")
    e = e.select(*keys, F.floor(k / d).cast("int").alias("i"), (k % d).cast("int").alias("j"), "__n", at(F.floor(k / d)).alias("__x"), at(k % d).alias("__y"), "__xy")
    s = e.groupBy(*keys, "i", "j").agg(F.sum("__n").alias("n"), F.sum("__x").alias("sx"), F.sum("__y").alias("sy"), F.sum("__xy").alias("sxy"))
    return s.select(*by, "i", "j", "n", (F.col("sx") / F.col("n")).alias("mean"), ((F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("n") - 1)).alias("cov"))


def frechet(m1: np.ndarray, c1: np.ndarray, m2: np.ndarray, c2: np.ndarray) -> float:
    """Squared distance of two Gaussians: |m1 - m2|^2 + tr(c1 + c2 - 2 (c1 c2)^(1/2))."""
    values, vectors = np.linalg.eigh(c1)
    root = vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T
    inner = np.linalg.eigvalsh(root @ c2 @ root)
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(inner, 0)).sum())


def shared_range(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "scaled", log: bool = False) -> DataFrame:
    """Adds value scaled by the least and greatest of its group (0 where they are equal); with log, of log1p. The groups'
    two numbers are aggregated first and joined, so no group is gathered in one task."""
    x = F.log1p(value) if log else F.col(value)
    ends = df.groupBy(*by).agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    joined = df.join(ends, list(by)) if by else df.crossJoin(F.broadcast(ends))  # one row
    return joined.withColumn(name, F.coalesce(F.try_divide(x - F.col("__low"), F.col("__high") - F.col("__low")), F.lit(0.0))).drop("__low", "__high")


def group_statistics(df: DataFrame, order: str, value: str, groups: int = 5) -> DataFrame:
    """Mean and population deviation of the means of contiguous groups of equal size; the rest falls to the last."""
    size = max(df.count() // groups, 1)
    k = dense_index(df, [order], "__at").withColumn("g", F.least(F.floor(F.col("__at") / size), F.lit(groups - 1)))
    return k.groupBy("g").agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"))


def psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Of two pixel arrays of equal length; null if they are equal."""
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))
