"""Preparation of benchmark rows: prompts, options, placeholders, ids, filters, times and frame choices, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

IMAGE = "<image>"


def choice_prompt(question: Column, options: Column, hint: Column | None = None) -> Column:
    """Hint, question, options and the request to choose; the parts that a row lacks are left out. options: map label -> text."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n")))
    chosen = F.concat(F.lit("Options:\n"), F.array_join(lines, ""), F.lit("Please select the correct answer from the options above. \n"))
    head = F.lit("") if hint is None else F.coalesce(F.concat(F.lit("Hint: "), hint, F.lit("\n")), F.lit(""))
    return F.concat(head, F.lit("Question: "), question, F.lit("\n"), F.when(F.size(options) > 0, chosen).otherwise(""))


def open_to_choice(df: DataFrame, first: str = "A", second: str = "B", answer: str = "answer") -> DataFrame:
    """A question without options gets two: its answer and 'Other Answers'."""
    bare = F.col(first).isNull()
    return df.withColumns({first: F.coalesce(first, answer), second: F.when(bare, "Other Answers").otherwise(F.col(second))})


def interleaved(text: Column, images: Column) -> Column:
    """array<struct<type, value>>: text pieces in order, an image in place of each placeholder while there are images left."""
    pieces = F.split(text, IMAGE)
    both = lambda x, i: F.filter(
        F.array(
            F.struct(F.lit("image").alias("type"), F.when((i > 0) & (i <= F.size(images)), F.get(images, i - 1)).alias("value")),
            F.struct(F.lit("text").alias("type"), F.nullif(x, F.lit("")).alias("value")),
        ),
        lambda m: m["value"].isNotNull(),
    )
    return F.flatten(F.transform(pieces, both))


def page_name(image: Column) -> Column:
    """An element's page: the id without its last '_' part, unless the id is a page's file name."""
    return F.when(image.endswith(".jpg"), image).otherwise(F.regexp_extract(image, r"(?s)\A(.*)_", 1))


def id_parts(ident: Column, names: Sequence[str], first: int = 3) -> list[Column]:
    """Parts of an id between '_', from the part numbered ``first``; null where it has fewer."""
    return [F.get(F.split(ident, "_"), first + k).alias(n) for k, n in enumerate(names)]


def whole_seconds(start: Column, end: Column, duration: Column) -> dict[str, Column]:
    """Times of a segment in whole seconds, halves to the even one, inside the video's whole seconds."""
    last = F.floor(duration)
    return {"start": F.bround(start).cast("long"), "end": F.least(F.bround(end).cast("long"), last), "duration": last}


def strided(items: Column, most: int) -> Column:
    """At most so many items, at even strides from the first."""
    n = F.size(items)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(items, F.floor(i * (n / F.lit(float(most)))).cast("int")))
    return F.when(n <= most, items).otherwise(picked)


def clue_frames(clues: Column, frames: int, fps: float) -> Column:
    """Frame numbers from clue intervals (array<struct<start, end>> in seconds): all, if there are no more than ``frames``;
    else each clue's share by length, one at least, at the middles of equal parts."""
    spans = F.transform(clues, lambda c: F.struct(F.bround(c["start"] * fps).cast("int").alias("a"), F.bround(c["end"] * fps).cast("int").alias("b")))
    total = F.aggregate(spans, F.lit(0), lambda s, c: s + c["b"] - c["a"])
    every = F.flatten(F.transform(spans, lambda c: F.when(c["b"] > c["a"], F.sequence(c["a"], c["b"] - 1)).otherwise(F.array().cast("array<int>"))))

    def part(c: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor(frames * ((c["b"] - c["a"]) / total)).cast("int"))
        step = (c["b"] - c["a"]) / n
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(c["a"] + step / 2 + step * i).cast("int"))

    return F.when(total <= frames, every).otherwise(F.flatten(F.transform(spans, part)))


def unsound(df: DataFrame, speaker: str, start: str, end: str, text: str) -> DataFrame:
    """Annotations with the first thing wrong with them; none for a sound table."""
    wrong = F.when(F.col(start).isNull() | F.col(end).isNull(), "no time").when(F.col(start) < 0, "negative start").when(F.col(end) < F.col(start), "ends before it starts")
    wrong = wrong.when(F.coalesce(F.trim(speaker), F.lit("")) == "", "no speaker").when(F.coalesce(F.trim(text), F.lit("")) == "", "no text")
    return df.withColumn("wrong", wrong).where("wrong is not null")


def read_buffer(df: DataFrame, at: str, length: int = 60, rate: int = 2, until: str | None = None, since: str | None = None) -> DataFrame:
    """For each tick (a whole second), the read that holds it: begin, end (cut at the video's end), its number of frames and
    the tick's first frame in it. Reads follow each other from the video's begin (``since``, 0 without). Ticks outside the video
    are left out."""
    first = F.lit(0) if since is None else F.col(since)
    df = df.where(F.col(at) >= first)
    begin = first + F.floor((F.col(at) - first) / length) * length
    end = begin + length if until is None else F.least(begin + length, F.col(until))
    inside = df if until is None else df.where(F.col(at) < F.col(until))
    return inside.withColumns({"read_begin": begin, "read_end": end, "frames": (end - begin) * rate, "first_frame": (F.col(at) - begin) * rate})


def others_comments(df: DataFrame, session: str, tick: str, speaker: str, comment: str, active: str, silence: str) -> DataFrame:
    """What each speaker of a tick is told: the active, non-silent comments of the others at the tick before, by speaker."""
    said = df.where(F.col(active) & (F.col(comment) != "") & (F.col(comment) != silence))
    heard = said.groupBy(session, (F.col(tick) + 1).alias(tick)).agg(F.array_sort(F.collect_list(F.struct(F.col(speaker).alias("by"), F.col(comment).alias("c")))).alias("heard"))
    told = lambda x: F.concat(F.lit("[SPEAKER_"), x["by"].cast("string"), F.lit("]: "), x["c"])
    joined = df.join(heard, [session, tick], "left")
    others = F.filter(F.coalesce("heard", F.expr("array()")), lambda x: x["by"] != F.col(speaker))
    return joined.withColumn("context", F.array_join(F.transform(others, told), "")).drop("heard")


def shifted_labels(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, ignore: int = -100) -> DataFrame:
    """Each place's prediction beside the next place's label; masked labels and last places drop out."""
    ahead = F.lead(label).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("target", ahead).where(F.col("target").isNotNull() & (F.col("target") != ignore))
