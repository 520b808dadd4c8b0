"""Golden tables of the operators, and round trips of the sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import consistency, generate, joins, ordered, report, stats
from scorelake.sources import tables
from scorelake.streaming import processors as P


def test_assignment_is_least_cost():
    from itertools import permutations

    r = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 3), (4, 4)):
        c = r.random((n, m))
        got = sum(c[i, j] for i, j in joins.assignment(c))
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in enumerate(p)) for p in permutations(range(n), m))
        assert got == pytest.approx(best)


def test_tail_repeats(spark):
    df = spark.createDataFrame([("abab",), ("aabaabaa",), ("abc",), ("",)], "t string")
    assert [r[0] for r in df.select(ordered.tail_repeats(F.col("t"), 3)).collect()] == [[1, 2, 1], [2, 1, 2], [1, 1, 1], [0, 0, 0]]


def test_smooth_and_fill(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 4.0, 8.0)], "v int, start double, end double")
    assert [(r["new_start"], r["new_end"]) for r in ordered.smooth(df, ["v"], ["start"]).orderBy("start").collect()] == [(0, 4.5), (4.5, 8)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.0, 0.0, 0.8, 0.0, 0.0, 0.6, 0.0])], "k int, i int, x double")
    assert [r["filled"] for r in ordered.forward_fill(df, ["k"], ["i"], "x").orderBy("i").collect()] == [0, 0, 0.8, 0.8, 0.8, 0.6, 0.6]


def test_clips_and_segments(spark):
    df = spark.createDataFrame([("v", 60)], "video string, duration int")
    assert [r["clip_begin"] for r in generate.windows(df, "duration").orderBy("clip_begin").collect()] == [0, 18, 36]
    df = spark.createDataFrame([("a b c d e f g",)], "t string")
    assert df.select(generate.even_segments(F.col("t"), F.lit(3))).first()[0] == ["a b c", "d e", "f g"]
    assert spark.range(1).select(generate.frames_by_count(F.lit(100), 3)).first()[0] == [25, 50, 75]


def test_circular_turns_back(spark):
    df = spark.createDataFrame([(7, "w", "x", "y", None, "B"), (8, "A", "q", "r", "s", "A")], "key long, A string, B string, C string, D string, answer string")
    out = generate.circular_options(df, "key", list("ABCD"), "answer").collect()
    assert len([r for r in out if r["g_index"] == 7]) == 3 and len([r for r in out if r["g_index"] == 8]) == 1
    assert all(r[r["answer"]] == "x" for r in out if r["g_index"] == 7)


def test_interval_join_and_as_of(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 130.0), (2, 5.0)], "k int, at double")
    i = spark.createDataFrame([(1, 0.0, 200.0, "a"), (1, 5.0, 6.0, "b")], "k int, start double, end double, n string")
    got = {(r["at"], r["n"]) for r in joins.points_in_intervals(p, i, "at", "start", "end", ["k"]).collect()}
    assert got == {(5.0, "a"), (130.0, "a")}
    r = spark.createDataFrame([(1, 4.0, "x"), (1, 100.0, "y")], "k int, seen double, v string")
    assert {(x["k"], x["at"], x["v"]) for x in joins.as_of(p, r, ["k"], "at", "seen").collect()} == {(1, 5.0, "x"), (1, 130.0, "y"), (2, 5.0, None)}


def test_match_lines(spark):
    df = spark.createDataFrame([(1, ["abc", "xyz"], ["xyzz", "abc", "q"]), (2, [], None)], "page long, targets array<string>, preds array<string>")
    got = {(r["target"], r["pred"], round(r["edit"], 3)) for r in joins.match_lines(df).collect()}
    assert got == {("abc", "abc", 0.0), ("xyz", "xyzz", 0.25), ("", "q", 1.0)}


def test_report_levels(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, hit int")
    got = {(r["kind"], r["name"]): r["acc"] for r in report.levels(df, {"Overall": None, "c": "c"}, {"acc": report.percent(F.col("hit"))}).collect()}
    assert got == {("Overall", "Overall"): pytest.approx(200 / 3, abs=1e-5), ("c", "a"): 50.0, ("c", "b"): 100.0}


def test_pairs_and_missing(spark):
    df = spark.createDataFrame([("x", True), ("x", True), ("y", True)], "k string, hit boolean")
    r = consistency.pair_accuracy(df, ["k"], F.col("hit")).first()
    assert (r["groups"], r["acc"]) == (2, 0.5)
    a, b = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([("p",), ("q",)], "b string")
    assert {tuple(r) for r in consistency.missing(a, b, spark.createDataFrame([(1, "p")], "a int, b string")).collect()} == {(1, "q"), (2, "p"), (2, "q")}


def test_frechet():
    one = np.eye(3)
    assert stats.frechet(np.zeros(3), one, np.zeros(3), one) == pytest.approx(0)
    assert stats.frechet(np.zeros(3), one, np.ones(3), 4 * one) == pytest.approx(6)


def test_state_machines():
    b = P.Budget(10)
    assert [b.add(4), b.add(4), b.add(4)] == [0, 0, 4] and b.entries == [4, 4]
    s = P.Sentences()
    assert s.add("a", "Hello there. How") == [("a", "Hello there.")]
    assert s.add("b", "x") == [("a", "How")]
    assert s.add("b", " ") == [] == s.add("b", None)
    assert s.flush() == [("b", "x")]
    s = P.Sentences()
    assert s.add("a", "It is 3.5 now! And") == [("a", "It is 3."), ("a", "5 now!")]
    assert s.add("a", "on ...") == [] and s.buffer == "And on"
    assert s.add("a", "1 2 3 4 5 6 7 8") == [("a", "And on 1 2 3 4 5 6 7 8")] and s.speaker is None
    assert s.add("b", "x.") == [("b", "x.")]
    assert s.add("a", "y. z") == [] and s.add("a", "w") == [("a", "y."), ] and s.buffer == "z w"
    ticks = [(0, "a", "Hi"), (1, "a", "you."), (2, "a", "More"), (3, "a", P.SILENCE), (4, "b", "Yes")]
    assert P.merge_ticks(ticks) == [(0, 2, "a", "Hi you."), (2, 4, "a", "More"), (4, 5, "b", "Yes")]


@pytest.mark.parametrize("kind", ["budget", "sentences"])
def test_streams_agree_with_batch(spark, tmp_path, kind):
    schema = "session long, seq long, tokens int, speaker string, text string"
    df = spark.createDataFrame([(s, i, 30 + i, "ab"[i % 3 == 0], f"word{i}" + "." * (i % 4 == 3)) for s in (1, 2) for i in range(12)], schema)
    ended = df if kind == "budget" else df.unionByName(spark.createDataFrame([(s, 12, 1, None, None) for s in (1, 2)], schema))
    for k in range(4):
        ended.where(f"seq div 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = P.budget_stream(stream, 100) if kind == "budget" else P.sentences_stream(stream)
    q = out.writeStream.format("memory").queryName(f"t_{kind}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table(f"t_{kind}").collect()}
    want = {tuple(r) for r in (P.budget_batch(df, 100) if kind == "budget" else P.sentences_batch(df)).collect()}
    assert got == want


def test_idle_sessions_are_flushed(spark, tmp_path):
    import time

    schema = "session long, seq long, speaker string, text string"
    spark.createDataFrame([(1, 0, "a", "Hi. Half a"), (1, 1, "a", "sentence")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = P.sentences_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), idle="1 second")
    q = out.writeStream.format("memory").queryName("t_idle").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while spark.table("t_idle").count() < 2 and time.time() < until:
            time.sleep(0.5)
    finally:
        q.stop()
    assert {tuple(r) for r in spark.table("t_idle").collect()} == {(1, 0, "a", "Hi."), (1, 1, "a", "Half a sentence")}


@pytest.mark.parametrize("fmt", ["tsv", "csv", "jsonl", "parquet", "orc"])
def test_load_and_dump(spark, tmp_path, fmt):
    df = spark.createDataFrame([("1", 'a "quoted"\ttext', "x")], "index string, question string, A string")
    tables.dump(df, path := str(tmp_path / f"t.{fmt}"))
    assert [tuple(r) for r in tables.load(spark, path).select("index", "question", "A").collect()] == [tuple(r) for r in df.collect()]


def test_table_rules(spark):
    df = spark.createDataFrame([("1", "q", "x", "y")], "Index string, Question string, A string, B string")
    low = tables.lower_columns(df)
    assert low.columns == ["index", "question", "A", "B"] and tables.kind_of(low) == "mcq"
    assert tables.integer_index(low).schema["index"].dataType.simpleString() == "bigint"
    sub = spark.createDataFrame([("1\n00:00:01,000 --> 00:00:02,500\nHello\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\nBye",)], "value string")
    assert [tuple(r) for r in tables.parse_subtitles(sub).collect()] == [(1.0, 2.5, "Hello\nyou"), (3.0, 4.0, "Bye")]
