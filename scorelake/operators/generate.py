"""Row generators: circular options, clips, seconds, frames, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import words


def circular_options(df: DataFrame, key: str, options: Sequence[str], answer: str, offset: int = 1_000_000) -> DataFrame:
    """A row of k options becomes k rows: rotation i moves every text i labels on, key becomes key + offset * i, g_index
    is key % offset. Rows whose option texts name labels (one that is a label, or holds two) stay as they are."""
    texts = F.array_compact(F.array(*[F.col(o) for o in options]))
    labels = F.slice(F.array(*[F.lit(o) for o in options]), F.lit(1), F.size(texts))
    tokens = lambda t: F.array_distinct(F.filter(F.split(t, r"[^A-Za-z]+"), lambda w: w.isin(list(options))))
    odd = F.exists(texts, lambda t: t.isin(list(options)) | (F.size(tokens(t)) >= 2))
    k = F.when(odd, 1).otherwise(F.greatest(F.size(texts), F.lit(1)))
    out = df.withColumn("rotation", F.explode(F.sequence(F.lit(0), k - 1)))
    size, r = F.size(texts), F.col("rotation")
    moved = {o: F.when(F.lit(i) < size, F.get(texts, F.pmod(F.lit(i) - r + size, size))) for i, o in enumerate(options)}
    turned = F.get(labels, F.pmod(F.array_position(labels, F.col(answer)).cast("int") - 1 + r, size))
    return out.withColumns(moved | {answer: F.when(F.array_position(labels, F.col(answer)) > 0, turned).otherwise(F.col(answer)), "g_index": F.col(key) % offset, key: F.col(key) + offset * r})


def even_segments(text: Column, n: Column) -> Column:
    """The words of a text as n segments of even size; the first ones take the remainder."""
    w = words(text)
    small, more = F.floor(F.size(w) / n).cast("int"), F.size(w) % n
    begin = lambda i: (i * small + F.least(i, more)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, begin(i) + 1, begin(i + 1) - begin(i)), " "))


def to_seconds(df: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """A sentence from start to end becomes one row per second with its share of the words."""
    n = F.greatest(F.ceil(F.col(end) - F.col(start)).cast("int"), F.lit(1))
    rows = df.select("*", F.posexplode(even_segments(F.col(text), n)).alias("__i", "segment"))
    return rows.withColumn("second", F.floor(F.col(start)).cast("long") + F.col("__i")).drop("__i")


def windows(df: DataFrame, duration: str, size: int = 36, step: int = 18, least: int = 9) -> DataFrame:
    """Clips [clip_begin, clip_end) of a length, every ``step``; clips under ``least`` go."""
    last = F.greatest(F.ceil(F.col(duration)).cast("int") - 1, F.lit(0))
    out = df.withColumn("clip_begin", F.explode(F.sequence(F.lit(0), last, F.lit(step))))
    out = out.withColumn("clip_end", F.least(F.col("clip_begin") + size, F.col(duration)))
    return out.where(F.col("clip_end") - F.col("clip_begin") >= least)


def frames_by_count(total: Column, n: int) -> Column:
    """Indices int(i * total / (n + 1)), i = 1..n."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.floor(i * total / (n + 1)).cast("int"))


def frames_by_rate(duration: Column, video_fps: Column, fps: float) -> Column:
    n = F.floor(duration * fps).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: F.floor(i * video_fps / fps).cast("int"))


def ngrams(tokens: Column, n: int) -> Column:
    count = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    starts = F.slice(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), F.lit(1), count)
    return F.transform(starts, lambda i: F.slice(tokens, i, F.lit(n)))


def fan_out(df: DataFrame, speakers: str, speaker: str, start: str, end: str) -> DataFrame:
    """One row per listed speaker: 'assistant' on its own lines, else 'user', a second later."""
    out = df.withColumn("viewer", F.explode(speakers))
    own = F.col("viewer") == F.col(speaker)
    return out.withColumns({"role": F.when(own, "assistant").otherwise("user"), start: F.when(own, F.col(start)).otherwise(F.col(start) + 1), end: F.when(own, F.col(end)).otherwise(F.col(end) + 1)})


def turns(clips: DataFrame, lines: DataFrame, keys: Sequence[str], begin: str, finish: str, second: str, text: str, silence: str = "<SILENCE>") -> DataFrame:
    """One row per second of each clip with the text said then, or silence."""
    each = clips.withColumn(second, F.explode(F.sequence(F.col(begin).cast("long"), F.col(finish).cast("long") - 1)))
    said = lines.groupBy(*keys, second).agg(F.array_join(F.array_sort(F.collect_list(text)), " ").alias(text))
    return each.join(said, [*keys, second], "left").withColumn(text, F.coalesce(text, F.lit(silence)))


def seeded_sample(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows per group, by a hash of the key."""
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), F.col(key))
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(h, key))).where(F.col("__k") <= n).drop("__k")
