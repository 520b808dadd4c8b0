"""The window of a text most like a needle: an inverted index of the needles' tokens, joined to places in the texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

#: Words, and marks one by one.
TOKENS = r"(?U)\w+|[^\w\s]"
#: Characters, for languages written without spaces.
CHARACTERS = r"(?U)\S"
#: Tokens of a broadcast at most, and the characters of each.
FREQUENT, SHORT = 1 << 17, 64


def tokens(text: Column, pattern: str = TOKENS) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), 0), F.array().cast("array<string>"))


def most_like(words: Sequence[str], needle: str, size: int, places: Sequence[int], sep: str) -> tuple[int, float]:
    """Start and likeness of the window of ``size`` words most like needle among those around places; the first of equals.

    Likeness is the share of characters in longest matching blocks. The share of characters that both have, in any order,
    bounds it, so windows go by that bound and end when it is below the best.
    """
    starts = sorted({s for p in places for s in range(max(p - size + 1, 0), min(p, len(words) - size) + 1)})
    matcher = SequenceMatcher(None, "", needle)
    bounds = []
    for s in starts:
        matcher.set_seq1(sep.join(words[s : s + size]))
        bounds.append((-matcher.quick_ratio(), s))
    best, at = 0.0, -1
    for bound, s in sorted(bounds):
        if -bound < best:
            break
        matcher.set_seq1(sep.join(words[s : s + size]))
        ratio = matcher.ratio()
        if ratio > best or ratio == best and s < at:
            best, at = ratio, s
    return at, best


def _scores(window: Column, needle: Column) -> dict[str, Column]:
    """Precision, recall, F1 and Jaccard of the sets of tokens; F1 of the tokens as they are counted; equality."""
    a, b = F.array_distinct(window), F.array_distinct(needle)
    both, one, two = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(window, x), count(needle, x)))
    return {
        "precision": both / one,
        "recall": both / two,
        "f1": F.lit(2.0) * both / (one + two),
        "jaccard": both / (one + two - both),
        "rouge1": F.lit(2.0) * shared / (F.size(window) + F.size(needle)),
        "exact_match": (window == needle).cast("double"),
    }


def _once(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """df without rows that repeat a key (whose rows are alike); only keys, and the rows of repeated ones, are dealt."""
    again = written(df.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).select(*key))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    once = df.alias("a").join(again.alias("b"), same, "left_anti")
    return once.unionByName(df.alias("a").join(again.alias("b"), same, "left_semi").dropDuplicates(list(key)))


def _rarest(h: DataFrame, index: DataFrame, rarest: int) -> DataFrame:
    """Of index (__n, token) the ``rarest`` tokens of each needle that the fewest hays have, of those that any has.

    How many hays have the tokens most asked for is broadcast, up to FREQUENT of them; only the others are dealt with their
    needles. So it does not hang on the size of a table whether the tokens of all needles and hays are dealt.
    """
    asked = written(index.groupBy("token").agg(F.count("*").alias("asked")))
    short, bits = F.length("token") <= SHORT, F.length(F.bin("asked"))
    tally = asked.groupBy(short.alias("short"), bits.alias("bits")).count().collect()  # a row for each power of two
    least, told = 65, 0
    for b, n in sorted(((x["bits"], x["count"]) for x in tally if x["short"]), reverse=True):
        if told + n > FREQUENT:
            break
        least, told = b, told + n
    near, rest = short & (bits >= least), told < sum(x["count"] for x in tally)
    words = h.select(F.explode(F.array_distinct("words")).alias("token"))
    if not rest:
        words = words.join(F.broadcast(asked.select("token")), "token", "left_semi")
    held = written(words.groupBy("token").agg(F.count("*").alias("held")).join(asked, "token"))
    ranked = index.join(F.broadcast(held.where(near).select("token", "held")), "token")
    if rest:
        others = index.join(F.broadcast(asked.where(near).select("token")), "token", "left_anti")
        ranked = ranked.unionByName(others.join(held.where(~near).select("token", "held"), "token"))
    rank = F.row_number().over(Window.partitionBy("__n").orderBy("held", "token"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= rarest).select("__n", "token")


def best_windows(hay: DataFrame, needles: DataFrame, hay_id: str, needle_id: str, on: Sequence[str] = (), rarest: int | None = None, pattern: str = TOKENS, sep: str = " ") -> DataFrame:
    """For each hay and needle that meet, the hay's window of as many tokens as the needle has that is most like it.

    hay: on, hay_id, text; needles: on, needle_id, needle. A window counts if it shares a token with the needle; with
    ``rarest``, one of that many of the needle's tokens that the fewest hays have (ties: the smaller token). With columns
    ``on`` each needle meets the hays of its key, and one that finds nothing there has a row of zeros; without, hays and needles
    meet by the tokens alone, and only those that do have rows. Needles of more tokens than a hay has, and needles
    without tokens, find nothing. Rows that repeat an id and a text count once; a null text has no tokens; null ids never meet.
    """
    texts = _once(hay.select(*on, hay_id, "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("__hay")), [*on, hay_id, "__hay"])
    h = texts.withColumn("words", tokens(F.col("text"), pattern)).drop("text")
    n = needles.select(*on, needle_id, "needle")
    if on:  # the others meet no hay
        n = n.join(written(hay.select(*on).distinct()), [*on], "left_semi")
    n = written(n.distinct().withColumn("__n", F.monotonically_increasing_id()))  # read several times, dealt once
    n = n.withColumn("asked", tokens(F.col("needle"), pattern))
    index = n.where(F.col(needle_id).isNotNull()).select("__n", F.explode(F.array_distinct("asked")).alias("token"))
    if rarest is not None:
        index = _rarest(h, index, rarest)
    if on:  # a hay is dealt once, with its key, and searched for the tokens of the needles that it meets there
        sought = n.drop("asked").join(index.groupBy("__n").agg(F.collect_list("token").alias("sought")), "__n")
        pairs = texts.drop("__hay").join(sought, [*on]).where(F.exists("sought", lambda x: F.contains("text", x)))
        pairs = pairs.withColumn("words", tokens(F.col("text"), pattern)).drop("text")
        places = F.transform("words", lambda w, k: F.when(F.array_contains("sought", w), k))
        pairs = pairs.withColumns({"places": F.array_compact(places), "asked": tokens(F.col("needle"), pattern)}).drop("sought")
    else:
        posting = h.select(hay_id, "__hay", F.posexplode("words").alias("place", "token"))
        met = posting.join(written(index), "token").groupBy(hay_id, "__hay", "__n").agg(F.collect_set("place").alias("places"))
        # needles first, as they are short: a hay is dealt once at most, as a text, and no row that carries one is dealt again
        met = written(met.join(n, "__n"))
        pairs = met.join(texts, [hay_id, "__hay"]).withColumn("words", tokens(F.col("text"), pattern)).drop("text", "__hay")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = list(zip(b["words"], b["needle"], b["asked"], b["places"], strict=True))
            found = [most_like(list(w), x, len(a), p.tolist(), sep) for w, x, a, p in own]
            kept = b.drop(columns=["words", "places"])
            kept["start"], kept["likeness"] = [s for s, _ in found], [v for _, v in found]
            kept["found"] = [list(w[s : s + len(a)]) if s >= 0 else [] for (w, _, a, _), (s, _) in zip(own, found, strict=True)]
            yield kept

    names = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"`{c}` {names[c]}" for c in pairs.columns if c not in ("words", "places")) + ", start int, likeness double, found array<string>"
    best = pairs.mapInPandas(run, schema).where(F.col("start") >= 0)
    scores = _scores(F.col("found"), F.col("asked"))
    best = best.select(*on, hay_id, needle_id, "needle", "__n", "start", F.array_join("found", sep).alias("best"), "likeness", *[v.alias(k) for k, v in scores.items()])
    if on:
        all_pairs = hay.select(*on, hay_id).distinct().join(n.drop("asked"), [*on])
        best = all_pairs.join(best.drop(needle_id, "needle"), [*on, hay_id, "__n"], "left")
    zeros = [F.coalesce(k, F.lit(0.0)).alias(k) for k in ("likeness", *scores)]
    return best.select(*on, hay_id, needle_id, "needle", "start", "best", *zeros)
