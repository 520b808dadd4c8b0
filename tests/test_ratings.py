"""Golden values of the named ratings."""

import pytest
from pyspark.sql import functions as F

from scorelake.operators import ratings as R


def one(df):
    return df.first().asDict()


def test_blocks_and_roll_up(spark):
    df = spark.createDataFrame([(i, h, "t", "ab"[i % 2]) for i, h in enumerate([True, True, True, False])], "i int, h boolean, task string, cat string")
    assert one(R.blocks_of(df, ["i"], 2, F.col("h"))) == {"overall": 0.5, "average": 0.75}
    assert {(r["task"], r["cat"], r["acc"]) for r in R.roll_up(df, ["task", "cat"], F.col("h")).collect()} == {(None, None, 0.75), ("t", None, 0.75), ("t", "a", 1.0), ("t", "b", 0.5)}


def test_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0), ("c", 1.0)], "k string, v double")
    got = {r["name"]: r["score"] for r in R.remapped_macro(df, "k", {"X": ["a", "b"], "Y": ["c", "d"]}, F.col("v")).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 1.0, "X": 0.75, "Y": 1.0, "Overall": 0.88}
    assert one(R.super_sums(df, "k", {"X": ["a", "b"]}, F.col("v"))) == {"X": 2.0, "total": 3.0}
    rows = R.ordered_splits(df, "k", ["c", "a"], {"v": F.avg("v")}).collect()
    assert [r["k"] for r in rows] == ["c", "a", "b", "Average"] and rows[-1]["v"] == pytest.approx(2.5 / 3) and rows[-1]["n"] == 4
    s = {r["name"]: (r["score"], r["n"]) for r in R.slices(df, {"a": F.col("k") == "a", "all": F.lit(True), "none": F.lit(False)}, F.col("v")).collect()}
    assert s == {"a": (0.5, 2), "all": (0.75, 4), "none": (None, 0)}


def test_counts_and_verdicts(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (5.0, 1.0)], "pred double, truth double")
    assert one(R.count_errors(df)) == {"acc": 0.3333, "oboa": 0.6667, "mae": 1.6667, "rmse": 2.3805}
    v = spark.createDataFrame([("correct",), ("incorrect",), ("not_attempted",), ("correct",)], "v string")
    got = one(R.attempted(v, "v"))
    assert got["accuracy_given_attempted"] == pytest.approx(2 / 3) and got["f1"] == pytest.approx(4 / 7)
    e = spark.createDataFrame([([True, False], []), ([], [True])], "c array<boolean>, s array<boolean>")
    assert one(R.precision_recall_events(e, "c", "s")) == {"recall": 0.75, "precision": 1.0, "f1": pytest.approx(6 / 7)}


def test_classifiers(spark):
    df = spark.createDataFrame([([1, 0, 1, 9], [7, 1, -100, 0])], "p array<int>, l array<int>")
    got = one(R.masked_confusion(df, "p", "l"))
    assert (got["n"], got["tp"], got["fp"]) == (2, 1, 1) and got["recall"] == 1.0
    df = spark.createDataFrame([("1", "1", 1.0), ("Not answerable", "2", 0.0), ("3", "Not answerable", 0.0)], "t string, p string, s double")
    assert one(R.answerable_f1(df, F.col("s"), F.col("t"), F.col("p")))["f1"] == 0.5


def test_pages_and_repeats(spark):
    df = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (2, 0, 5)], "page int, e int, n int")
    assert one(R.page_edit(df, "page", "e", "n")) == {"pages": 2, "edit": 0.25}
    df = spark.createDataFrame([("f", "a", True), ("f", "a", True), ("f", "a", False), ("f", "b", False)], "file string, test string, ok boolean")
    assert {r["file"]: r["rate"] for r in R.repeats_pass(df, "file", "test", F.col("ok")).collect()} == {"f": 0.5, "mean": 0.5}
    df = spark.createDataFrame([(1, 0.25, 1), (2, 0.6, 0)], "k int, i double, s int")
    assert one(R.recall_at(df, "k", "i", "s")) == {"rec_iou": pytest.approx(0.7), "acc_iou": pytest.approx(0.2)}
    df = spark.createDataFrame([("x", 0.1)] * 10, "k string, v double")
    assert one(R.running_rounded_sum(df, "k", "v"))["score"] == 1.0


def test_cider(spark):
    df = spark.createDataFrame([(1, "a cat sat here".split(), ["a cat sat here".split()]), (2, "dogs run very fast".split(), ["birds fly up high".split()])], "id int, pred array<string>, targets array<array<string>>")
    got = {r["id"]: r["cider"] for r in R.cider(df).collect()}
    assert got[1] == pytest.approx(10) and got[2] == 0
