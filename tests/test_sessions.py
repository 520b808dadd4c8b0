"""Sessions in batch and as streams, with restarts; files as rows."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from scorelake.sources import files
from scorelake.streaming import sessions

FRAME = {"ts": 1, "w": 2, "h": 3, "data": "x"}


def message(kind, rid=1, **more):
    return json.dumps({"type": kind, "request_id": rid, **more})


def test_answers():
    s = sessions.Session(infer_ms=1000, idle_ms=5000)
    assert s.add(0, message("hello")) == [(0, None, "status", "hello received")]
    assert s.add(10, message("set_params", 2, threshold=0.4)) == [(10, 2, "status", "ok")] and s.threshold == {"0": 0.4}
    for bad in (message("set_params", 2, threshold=1.2), message("set_params", 2), message("set_params", 2, threshold=True), message("set_params", 2, threshold=0.1, assistant_id="x")):
        assert s.add(11, bad) == [(11, 2, "error", "bad set_params")]
    assert s.add(11, message("set_params", None, threshold=0.1)) == [(11, None, "error", "bad set_params")]
    assert s.add(12, message("infer", 3, ts=1, frames=[FRAME] * 3, query="who?")) == []
    assert len(s.frames) == 2
    assert s.add(500, message("clear_cache", 4)) == [(500, 4, "error", sessions.BUSY)]
    assert s.add(500, message("infer", 5, ts=1, frames=[])) == [(500, 5, "error", sessions.BUSY)]
    assert s.add(600, message("hello")) == [(600, None, "status", "hello received")]
    assert s.add(1012, message("clear_cache", 6)) == [(1012, 3, "comment", "2 frames: who?"), (1012, 6, "status", "ok")]
    assert s.frames == []
    assert s.add(1100, message("set_system_prompt", 7, system_prompt="p", assistant_id=2)) == [(1100, 7, "status", "ok")] and s.prompt == {"2": "p"}
    assert s.add(1100, message("set_system_prompt", 7, system_prompt="p" * 5001)) == [(1100, 7, "error", "bad set_system_prompt")]
    assert s.add(1200, message("set_assistant_count", 8, count=3)) == [(1200, 8, "status", "Assistant count set to 3")]
    assert (s.assistants, s.threshold, s.prompt) == (3, {}, {})
    assert s.add(1200, message("set_assistant_count", 8, count=11)) == [(1200, 8, "error", "bad set_assistant_count")]
    for bad in (None, "", "{", "[1]", "3", '"type"', "null"):
        assert s.add(1300, bad) == [(1300, None, "error", "invalid json")], bad
    assert s.add(1300, "{}") == [(1300, None, "error", "unknown type: None")]
    assert s.add(1300, message("infer", 9, ts=1)) == [(1300, None, "error", "bad infer payload")]
    assert s.add(1400, message("x")) == [(1400, None, "error", "unknown type: x")]
    assert s.assistants == 3
    s.add(1400 + 5000, message("hello"))
    assert s.assistants == 1  # forgotten


def made(n, seed):
    r = random.Random(seed)
    kinds = [lambda k: message("hello", k), lambda k: message("infer", k, ts=k, frames=[FRAME] * r.randint(0, 3), query=r.choice([None, "q"])), lambda k: message("set_params", k, threshold=r.choice([0.5, 2])), lambda k: message("clear_cache", k), lambda k: message("set_assistant_count", k, count=r.choice([2, 50])), lambda k: "{"]
    at, rows = 0, []
    for k in range(n):
        at += r.choice([0, 100, 300, 700, 9000])
        rows.append((r.choice(["a", "b", "c"]), at, k, r.choice(kinds)(k)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "session string, at long, seq long, value string").select("session", F.timestamp_millis("at").alias("ts"), "seq", "value")


def plain(rows, infer_ms, idle_ms):
    states, out = {}, []
    for name, at, _, value in sorted(rows, key=lambda x: (x[1], x[2])):
        out += [(name, *a) for a in states.setdefault(name, sessions.Session(infer_ms, idle_ms)).add(at, value)]
    return sorted(out + [(name, *a) for name, s in states.items() for a in s.due(1 << 62)], key=str)


def test_batch(spark):
    rows = made(120, 3)
    got = sorted((tuple(x) for x in sessions.sessions_batch(frame(spark, rows).repartition(5), 500, 8000).collect()), key=str)
    assert got == plain(rows, 500, 8000)
    assert {k for _, _, _, k, _ in got} == {"status", "error", "comment"} and any(t == sessions.BUSY for *_, t in got)
    assert sessions.sessions_batch(frame(spark, []), 500, 8000).count() == 0
    odd = spark.sql("SELECT cast(null AS string) AS session, timestamp'2020-01-01' AS ts, 1 AS seq, cast(null AS string) AS value UNION ALL SELECT 'z', null, 2, '{}'")
    assert [tuple(x)[2:] for x in sessions.sessions_batch(odd).collect()] == [(None, "error", "invalid json")]


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = made(60, 5)
    rows.append(("end", rows[-1][1] + 100_000, 999, message("hello")))  # time goes on past all that is due
    schema = "session string, ts timestamp, seq long, value string"

    def put(part, name):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / "made" / name))
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / "made" / name).glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{name}.parquet")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = sessions.sessions_stream(stream, 500, 8000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
        q.awaitTermination()

    try:
        put(rows[:25], "a")
        run()
        put(rows[25:50], "b")  # a new query takes up what the last one left
        put(rows[50:], "c")
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == plain(rows, 500, 8000)


@pytest.fixture
def folder(tmp_path):
    for name, body in {"a.txt": b"one", "b.mp4": b"", "x/c.mp4": b"three" * 500_000, "x/y/d.mp4": b"four", "x/y/question_only/d.mp4": b"5", "x y/e é.txt": b"6"}.items():
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    return tmp_path / "in"


def test_files(spark, folder):
    names = lambda **o: {x["name"] for x in files.files(spark, str(folder), **o).collect()}
    assert names() == {"a.txt", "b.mp4"}
    assert names(level="2") == {"c.mp4", "e é.txt"}
    assert names(level="2+") == {"a.txt", "b.mp4", "c.mp4", "e é.txt"}
    assert names(level="+", match=[".mp4", "!question_only"]) == {"b.mp4", "c.mp4", "d.mp4"}
    df = files.files(spark, str(folder), level="+")
    assert df.rdd.getNumPartitions() == 6
    rows = {x["path"].removeprefix(f"{folder}/"): x for x in df.collect()}
    assert rows["x/c.mp4"]["size"] == 2_500_000 and rows["x/c.mp4"]["digest"] == hashlib.md5(b"three" * 500_000).hexdigest()
    assert rows["x/y/d.mp4"]["category"] == "y" and rows["x/y/d.mp4"]["level"] == 3 and rows["b.mp4"]["size"] == 0
    known = spark.createDataFrame([("a.txt", hashlib.md5(b"one").hexdigest().upper()), ("c.mp4", "0" * 32), ("gone", "1"), ("d.mp4", hashlib.md5(b"5").hexdigest())], "name string, digest string")
    got = {x["name"]: (x["state"], len(x["paths"])) for x in files.intact(df, known).collect()}
    assert got == {"a.txt": ("intact", 1), "c.mp4": ("changed", 0), "gone": ("missing", 0), "d.mp4": ("intact", 1)}
    ids = spark.createDataFrame([("d",), ("c",), ("zz",), (None,)], "id string")
    held = {x["id"]: x["video"] for x in files.pointed(ids, df, "id", "video", ".mp4", "question_only").collect()}
    assert held == {"d": f"{folder}/x/y/d.mp4", "c": f"{folder}/x/c.mp4", "zz": None, None: None}


def test_empty_and_missing_folders(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert files.files(spark, str(tmp_path / "none"), level="+").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        files.files(spark, str(tmp_path / "nowhere")).count()


def test_category_from_the_path(spark, tmp_path):
    for name, n in (("Art", 2), ("Bio logy", 3)):
        spark.range(n).write.parquet(str(tmp_path / "in" / name))
    got = files.categorised(spark, str(tmp_path / "in")).groupBy("category").count().collect()
    assert {tuple(x) for x in got} == {("Art", 2), ("Bio logy", 3)}
