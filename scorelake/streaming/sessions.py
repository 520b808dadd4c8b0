"""Sessions of messages: a control plane whose changes are refused while an inference runs, in batch and as a stream.

A message is JSON with a type. ``hello`` is always answered. ``infer`` makes the session busy for a while and ends in a comment;
``set_params``, ``set_system_prompt``, ``clear_cache`` and ``set_assistant_count`` change the session at once, unless it is
busy. Every message has one answer: a status, an error, or, when it is done, a comment. A session that hears nothing for long
enough is forgotten, and begins anew with its next message.

The rules are in ``Session``, which knows no clock but the messages'. ``sessions_batch`` runs it over rows sorted by session and
time; ``sessions_stream`` keeps it in value and list state, with timers for the end of an inference and of the session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: The largest number of assistants, and the longest system prompt.
ASSISTANTS, PROMPT = 10, 5000
SOURCES = ("webcam", "screen", "file", "unknown")
BUSY = "busy: inference in progress"
OUT = StructType([StructField("session", StringType()), StructField("at", LongType()), StructField("request_id", LongType()), StructField("kind", StringType()), StructField("text", StringType())])
#: at (milliseconds), request_id, kind, text
Answer = tuple[int, int | None, str, str]


def _whole(value) -> int | None:
    """A whole number, also one written as text or with an empty fraction; null for anything else."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    try:
        return int(value) if float(value) == int(float(value)) else None
    except (ValueError, OverflowError):
        return None


def _share(value) -> float | None:
    try:
        return float(value) if not isinstance(value, bool) and 0 <= float(value) <= 1 else None
    except (TypeError, ValueError):
        return None


@dataclass
class Session:
    """State of a session, and its answers to messages. Times are milliseconds."""

    infer_ms: int = 1000
    idle_ms: int = 600_000
    threshold: dict[str, float] = field(default_factory=dict)
    prompt: dict[str, str] = field(default_factory=dict)
    assistants: int = 1
    busy_until: int | None = None
    request: int | None = None
    query: str | None = None
    last: int | None = None
    frames: list[int] = field(default_factory=list)

    def due(self, now: int) -> list[Answer]:
        """What falls due until now: a comment, and the end of the session."""
        out: list[Answer] = []
        if self.busy_until is not None and self.busy_until <= now:
            out.append((self.busy_until, self.request, "comment", f"{len(self.frames)} frames{': ' + self.query if self.query else ''}"))
            self.busy_until = self.request = self.query = None
        if self.last is not None and self.busy_until is None and self.last + self.idle_ms <= now:
            self.__init__(self.infer_ms, self.idle_ms)
        return out

    def add(self, at: int, value: str | None) -> list[Answer]:
        """Answers that fall due before a message, and to it."""
        return self.due(at) + self._answer(at, value)

    def _answer(self, at: int, value: str | None) -> list[Answer]:
        self.last = at
        try:
            m = json.loads(value or "")
            kind = m["type"] if "type" in m else None
            if not isinstance(m, dict):
                raise ValueError
        except (ValueError, TypeError, RecursionError):
            return [(at, None, "error", "invalid json")]
        if kind == "hello":
            return [(at, None, "status", "hello received")]
        if kind == "infer":
            return self._infer(at, m)
        if kind not in ("set_params", "clear_cache", "set_system_prompt", "set_assistant_count"):
            return [(at, None, "error", f"unknown type: {kind}")]
        rid = _whole(m.get("request_id"))
        if self.busy_until is not None:
            return [(at, rid, "error", BUSY)]
        who = m.get("assistant_id")
        bad = rid is None or kind != "set_assistant_count" and who is not None and _whole(who) is None
        text = getattr(self, f"_{kind}")(m, range(self.assistants) if who is None else [_whole(who)]) if not bad else None
        return [(at, rid, "error", f"bad {kind}") if text is None else (at, rid, "status", text)]

    def _infer(self, at: int, m: dict) -> list[Answer]:
        rid, frames = _whole(m.get("request_id")), m.get("frames")
        good = rid is not None and _whole(m.get("ts")) is not None and m.get("source", "unknown") in SOURCES and isinstance(m.get("query"), str | None)
        if not good or not isinstance(frames, list) or not all(isinstance(f, dict) and isinstance(f.get("data"), str) and all(_whole(f.get(c)) is not None for c in ("ts", "w", "h")) for f in frames):
            return [(at, None, "error", "bad infer payload")]
        if self.busy_until is not None:
            return [(at, rid, "error", BUSY)]
        self.frames += [_whole(f["ts"]) for f in frames[:2]]  # two frames a request are looked at
        self.busy_until, self.request, self.query = at + self.infer_ms, rid, m.get("query")
        return []

    def _set_params(self, m: dict, who) -> str | None:
        if (share := _share(m.get("threshold"))) is None:
            return None
        self.threshold |= {str(i): share for i in who}
        return "ok"

    def _set_system_prompt(self, m: dict, who) -> str | None:
        if not isinstance(text := m.get("system_prompt"), str) or len(text) > PROMPT:
            return None
        self.prompt |= {str(i): text for i in who}
        return "ok"

    def _clear_cache(self, m: dict, who) -> str:
        self.frames = []
        return "ok"

    def _set_assistant_count(self, m: dict, who) -> str | None:
        n = _whole(m.get("count"))
        if n is None or not 1 <= n <= ASSISTANTS:
            return None
        self.__init__(self.infer_ms, self.idle_ms, assistants=n, last=self.last)  # assistants are made anew
        return f"Assistant count set to {n}"


def _millis(df: DataFrame) -> DataFrame:
    return df.select(F.col("session").cast("string").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "seq", "value")


def sessions_batch(df: DataFrame, infer_ms: int = 1000, idle_ms: int = 600_000) -> DataFrame:
    """session, at, request_id, kind, text: all answers to df (session, ts, seq, value), with what is due at the end.

    Rows are dealt by session and sorted by ts, then seq; one session is in memory at a time, and of it only its state. A null
    session is one session; a null ts has no place in time, and no answer.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, None
        for b in batches:
            out: list[tuple] = []
            for session, at, value in zip(b["session"], b["at"], b["value"], strict=True):
                if state is None or session != name:
                    if state is not None:
                        out += [(name, *a) for a in state.due(1 << 62)]
                    name, state = session, Session(infer_ms, idle_ms)
                out += [(name, *a) for a in state.add(int(at), value)]
            yield pd.DataFrame(out, columns=OUT.names).astype({"request_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([(name, *a) for a in state.due(1 << 62)], columns=OUT.names).astype({"request_id": "Int64"})

    rows = _millis(df).where("at is not null").withColumn("session", F.coalesce("session", F.lit("")))
    return rows.repartition("session").sortWithinPartitions("session", "at", "seq").mapInPandas(run, OUT)


class Processor(StatefulProcessor):
    """``Session`` in state: its settings as one value, the frames that it holds as a list, timers for what falls due."""

    def __init__(self, infer_ms: int, idle_ms: int):
        self.infer_ms, self.idle_ms = infer_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settings = handle.getValueState("settings", StructType([StructField("json", StringType())]))
        self.frames = handle.getListState("frames", StructType([StructField("ts", LongType())]))

    def _load(self) -> Session:
        if not self.settings.exists():
            return Session(self.infer_ms, self.idle_ms)
        return Session(**json.loads(self.settings.get()[0]), frames=[r[0] for r in self.frames.get()])

    def _store(self, s: Session) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.settings.clear()
        self.frames.clear()
        if s.last is None:
            return
        held = asdict(s)
        frames = held.pop("frames")
        self.settings.update((json.dumps(held),))
        if frames:
            self.frames.put([(t,) for t in frames])
        self.handle.registerTimer(s.busy_until if s.busy_until is not None else s.last + s.idle_ms)

    def _told(self, key, out: list[Answer]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *a) for a in out], columns=OUT.names).astype({"request_id": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, out = self._load(), []
        for r in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples(index=False):
            out += state.add(int(r.at), r.value)
        self._store(state)
        yield from self._told(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self._load()
        out = state.due(expiredTimerInfo.getExpiryTimeInMs())
        self._store(state)
        yield from self._told(key, out)

    def close(self) -> None:
        pass


def sessions_stream(df: DataFrame, infer_ms: int = 1000, idle_ms: int = 600_000, late: str = "0 seconds") -> DataFrame:
    """The same over a stream of (session, ts, seq, value) whose rows come in the order of ts, but for ``late``.

    Timers go by the watermark: a comment is given out once messages of any session are past its time. The state store must be
    RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    rows = df.select(F.coalesce(F.col("session").cast("string"), F.lit("")).alias("session"), F.col("ts").cast("timestamp").alias("ts"), "seq", "value").where("ts is not null")
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("session").transformWithStateInPandas(Processor(infer_ms, idle_ms), OUT, "append", "EventTime")
