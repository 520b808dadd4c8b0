"""Per-second ticks and stateful processors. Each state machine is plain Python, and runs both in batch (per session, in
order) and in a stream (``applyInPandasWithState``)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.shared import shared_folder

SILENCE = "<SILENCE>"


class Budget:
    """First-in-first-out entries under a token budget: when it is passed, whole oldest entries go until a fifth of the
    budget is gone. The first ``pinned`` tokens never go."""

    def __init__(self, budget: int, share: float = 0.2, pinned: int = 0, entries: list[int] | None = None):
        self.budget, self.share, self.pinned, self.entries = budget, share, pinned, entries or []

    def add(self, tokens: int) -> int:
        """Tokens evicted by this entry."""
        self.entries.append(tokens)
        gone = 0
        if self.pinned + sum(self.entries) > self.budget:
            while self.entries and gone < self.share * self.budget:
                gone += self.entries.pop(0)
        return gone


class Sentences:
    """Buffers a speaker's text; gives out each whole sentence, ten words without an end, or all when the speaker changes.

    Every end mark closes a sentence, inside numbers too. Blank texts change nothing; a closing " ..." is no end and goes.
    After ten words given out nobody is the speaker, so whoever comes next begins anew.
    """

    END = re.compile(r"[^.!?]*[.!?]")

    def __init__(self, speaker: str | None = None, buffer: str = "", most: int = 10):
        self.speaker, self.buffer, self.most = speaker, buffer, most

    def add(self, speaker: str, text: str | None) -> list[tuple[str, str]]:
        if text is None or not text.strip():
            return []
        if text.endswith(" ..."):
            text = text[:-4].strip()
        if self.speaker not in (None, speaker):
            out = self.flush()
            self.speaker, self.buffer = speaker, text
            return out
        self.speaker, self.buffer = speaker, f"{self.buffer} {text}"
        if whole := self.END.findall(self.buffer):
            self.buffer = self.buffer[sum(map(len, whole)) :].strip()
            return [(speaker, x.strip()) for x in whole]
        if len(self.buffer.strip().split(" ")) >= self.most:
            out = self.flush()
            self.speaker = None
            return out
        return []

    def flush(self) -> list[tuple[str, str]]:
        out = [(self.speaker, self.buffer.strip())] if self.buffer.strip() else []
        self.buffer = ""
        return out


def merge_ticks(ticks: list[tuple[int, str, str]], most: int = 5) -> list[tuple[int, int, str, str]]:
    """(begin, end, speaker, text) of consecutive ticks (second, speaker, text): a segment takes in ticks of its speaker
    and silent ones, ends at a sentence end once it has two, at ``most``, or at another speaker; silence after it joins."""
    out, k = [], 0
    while k < len(ticks):
        second, speaker, text = ticks[k]
        k += 1
        if text == SILENCE:
            continue
        said, n, end = [text], 1, second
        while k < len(ticks) and n < most and (ticks[k][1] == speaker or ticks[k][2] == SILENCE):
            if n > 1 and said[-1].rstrip().endswith((".", "!", "?")):
                break
            if ticks[k][2] != SILENCE:
                said.append(ticks[k][2])
            end, n, k = ticks[k][0], n + 1, k + 1
        while k < len(ticks) and ticks[k][2] == SILENCE:
            end, k = ticks[k][0], k + 1
        out.append((second, end + 1, speaker, " ".join(said)))
    return out


def budget_batch(df: DataFrame, budget: int) -> DataFrame:
    """session, seq, held, evicted after each entry of df (session, seq, tokens), in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Budget(budget), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            gone = state.add(int(r.tokens))
            out.append((r.session, r.seq, sum(state.entries), gone))
        return pd.DataFrame(out, columns=["session", "seq", "held", "evicted"])

    return df.groupBy("session").applyInPandas(run, "session long, seq long, held long, evicted long")


def budget_stream(df: DataFrame, budget: int) -> DataFrame:
    """The same over a stream; entries that wait are the state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Budget(budget, entries=list(state.get[0]) if state.exists else [])
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            gone = held.add(int(r.tokens))
            out.append((key[0], r.seq, sum(held.entries), gone))
        state.update((held.entries,))
        yield pd.DataFrame(out, columns=["session", "seq", "held", "evicted"])

    return df.groupBy("session").applyInPandasWithState(run, "session long, seq long, held long, evicted long", "entries array<int>", "append", GroupStateTimeout.NoTimeout)


def sentences_batch(df: DataFrame) -> DataFrame:
    """session, n, speaker, sentence of df (session, seq, speaker, text), in order of emission."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = Sentences(), []
        for r in pdf.sort_values("seq").itertuples(index=False):
            out += state.add(r.speaker, r.text)
        out += state.flush()
        return pd.DataFrame([(pdf["session"].iloc[0], k, s, x) for k, (s, x) in enumerate(out)], columns=["session", "n", "speaker", "sentence"])

    return df.groupBy("session").applyInPandas(run, "session long, n long, speaker string, sentence string")


def sentences_stream(df: DataFrame, idle: str | None = None) -> DataFrame:
    """The same over a stream. A session's rest is given out when a row without speaker ends it and, if ``idle`` is given,
    when no row of it has come for so long; its numbers go on if it does come back. A query with ``idle`` runs until it is
    stopped, as time goes on without rows: it needs a processing-time trigger, not one that ends with the input."""
    period = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        speaker, buffer, n = state.get if state.exists else (None, "", 0)
        held, out = Sentences(speaker, buffer), []
        if period and state.hasTimedOut:
            out += held.flush()
        else:
            for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
                out += held.flush() if r.speaker is None else held.add(r.speaker, r.text)
        state.update((held.speaker, held.buffer, n + len(out)))
        if period and held.buffer.strip():
            state.setTimeoutDuration(period)
        yield pd.DataFrame([(key[0], n + k, s, x) for k, (s, x) in enumerate(out)], columns=["session", "n", "speaker", "sentence"])

    return df.groupBy("session").applyInPandasWithState(run, "session long, n long, speaker string, sentence string", "speaker string, buffer string, n long", "append", GroupStateTimeout.ProcessingTimeTimeout if period else GroupStateTimeout.NoTimeout)


def ticks(stream: DataFrame, every: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of value per event_type and tumbling window of ts (a timestamp)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def hopping(stream: DataFrame, size: str, hop: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, hop).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The event files as a stream; ts becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    name = path.rstrip("/").rpartition("/")
    single = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if not path.endswith(".parquet") else name[2])
    return single.parquet(name[0]).withColumn("ts", F.col("ts").cast("timestamp"))


def tick_table(spark: SparkSession, path: str, every: str) -> DataFrame:
    """Runs the tick stream over all that is there, and returns its table, which each batch writes anew to the shared folder."""
    out = f"{shared_folder(spark)}/ticks-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = ticks(read_ticks(spark, path), every).writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.unix_timestamp("w.start").alias("tick"), "event_type", "n", F.round("total", 4).alias("total"))


def valid_messages(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON control messages: type, request_id, threshold, speed, text, and why a message is bad (null: it is good)."""
    m = F.from_json(column, "type string, request_id string, threshold double, speed double, text string")
    p = df.withColumn("m", m).select("*", "m.*").drop("m")
    bad = F.when(F.col("type").isNull(), "not a message").when(~F.col("threshold").between(0, 1), "threshold out of range").when(~F.col("speed").between(1, 10), "speed out of range").when(F.length("text") > 5000, "text too long")
    return p.withColumn("error", bad)
