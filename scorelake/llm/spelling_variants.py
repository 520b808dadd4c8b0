"""Grouping of spelling variants: a trie self-join with active-node sets at distance one.

Words are runs of Latin letters, counted over all documents; one run in about 199, chosen by a checksum of document and
run, counts with one letter left out. Two words are near if one inserted, deleted or replaced code point makes them equal.

Near words u and v of lengths l <= m have one edit, at the end of their common prefix. So the vocabulary is dealt into
groups by (l, an interval [a, b) of places of the edit, the a code points before it, the l - b code points after it): near
words whose edit lies in the interval share both. A word goes to the groups of l = its length, and of l = its length - 1.
At first the interval is either half of a word. A group of more than MOST words is dealt anew, with its interval halved;
an interval of one place has at most one word a letter and one more, so every group gets small enough, whatever words there are.

Inside a group the middles of its words are a trie. Its nodes are walked from the root; each has its active nodes, those
whose strings are at most one edit away, which come from its parent's. Where two ends of words are active to each other
at distance one, they are near.

A word's form is its near word with the largest count, if that is at least TIMES its own; root follows forms to the last.
Counts grow TIMES-fold along that way, so it is short; it is followed by doubling.

Defined cases: null and empty texts have no words; a null doc_id stands as the empty string in the checksum; repeated rows
count each time; ties of forms go to the smaller word in code-point order; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bound_batches, discard, table, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
SPARED = 199
TIMES = 5
#: Words that one group's trie may hold.
MOST = 4096
#: Words that a task counts before it hands them on.
_COUNTED = 1 << 18
GROUP = ["l", "a", "b", "head", "tail"]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def occurrences(doc_id: str, text: str | None, least: int, spared: int) -> Iterator[tuple[str, int]]:
    """Words of a document of at least ``least`` code points, after the left-out letters, and how often each occurs."""
    if not text:
        return
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    base = crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
    for run, n in Counter(re.findall(f"[a-zÀ-ÿ]{{{least},}}", lowered)).items():
        h = crc32(run.encode(), base)
        if h % spared:
            yield run, n
        elif len(run) > least:
            at = h % len(run)
            yield run[:at] + run[at + 1 :], n


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, spared: int = SPARED) -> DataFrame:
    """word, n of all words of docs (doc_id, text) with at least ``count`` occurrences."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                for word, n in occurrences(doc_id, text, least, spared):
                    total[word] = total.get(word, 0) + n
                if len(total) > _COUNTED:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total = {}
        yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInPandas(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def near_in_trie(strings: list[str]) -> Iterator[tuple[int, int, int]]:
    """(i, j, common prefix) of all pairs at distance one, i's string the shorter or, of equal lengths, the smaller.

    The trie is walked from the root. active[v] is the distance, 0 or 1, of node v's string to the walked node's; a
    child's active nodes come from its parent's: the same nodes with the letter left out, their children with the letter
    matched or replaced, and the children of matched ones with a letter put in.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for k, s in enumerate(strings):
        node = 0
        for c in s:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = k
    todo = [(0, {0: 0} | dict.fromkeys(children[0].values(), 1))]
    while todo:
        node, active = todo.pop()
        if (i := ends[node]) >= 0:
            s = strings[i]
            for v, d in active.items():
                if d == 1 and (j := ends[v]) >= 0 and (len(s), s) < (len(strings[j]), strings[j]):
                    t = strings[j]
                    yield i, j, next((k for k, (x, y) in enumerate(zip(s, t, strict=False)) if x != y), len(s))
        for c, child in children[node].items():
            new: dict[int, int] = {}
            for v, d in active.items():
                if d == 0:
                    new.setdefault(v, 1)  # the letter left out
                    for x, y in children[v].items():
                        if x == c:
                            new[y] = 0
                            for z in children[y].values():
                                new.setdefault(z, 1)  # a letter put in
                        else:
                            new.setdefault(y, 1)  # the letter replaced
                elif (y := children[v].get(c)) is not None:
                    new.setdefault(y, 1)
            todo.append((child, new))


def _joined_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each group; rows (word, middle, and the group's columns) come group by group."""
    group, words, middles = None, [], []

    def joined() -> Iterator[tuple[str, str]]:
        if len(words) > 1:
            length, a, b = group[:3]
            for i, j, common in near_in_trie(middles):
                if common < b - a and len(words[i]) == length:  # else the edit is in the next interval, or the shorter word is longer
                    yield words[i], words[j]

    def told(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.string()), "v": pa.array([p[1] for p in pairs], pa.string())})

    for batch in batches:
        pairs: list[tuple[str, str]] = []
        for word, middle, *key in zip(*(batch.column(c).to_pylist() for c in ("word", "middle", *GROUP)), strict=True):
            if key != group:
                pairs += joined()
                group, words, middles = key, [], []
            words.append(word)
            middles.append(middle)
        yield told(pairs)
    yield told(list(joined()))


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """u, v of all near words, each pair once. words: word, distinct."""
    length = F.length("word")
    short = F.explode(F.array(length, length - 1)).alias("l")
    dealt = words.select("word", short).where("l > 0")
    middle = F.floor(F.col("l") / 2).cast("int")
    dealt = dealt.select("word", "l", F.explode(F.array(F.struct(F.lit(0).alias("a"), middle.alias("b")), F.struct(middle.alias("a"), (F.col("l") + 1).alias("b")))).alias("of")).select("word", "l", "of.a", "of.b")
    found = None
    while True:
        # the l - b code points after the edit; in the last interval the edit may be behind the last one
        after = F.greatest(F.col("l") - F.col("b"), F.lit(0))
        keyed = dealt.select("*", F.expr("left(word, a)").alias("head"), after.alias("n_tail"))
        keyed = keyed.select("*", F.expr("right(word, n_tail)").alias("tail"), F.expr("substring(word, a + 1, length(word) - a - n_tail)").alias("middle"))
        held = written(keyed.select("word", "middle", *GROUP))
        wide = written(held.groupBy(*GROUP).agg(F.count("*").alias("size")).where((F.col("size") > most) & (F.col("b") - F.col("a") > 1)).select(*GROUP))
        last = wide.isEmpty()
        fit = held if last else held.join(wide, GROUP, "left_anti")
        new = written(fit.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_joined_groups, "u string, v string"))
        found = new if found is None else found.unionByName(new)
        if last:
            discard(held, wide)
            return found
        cut = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a").alias("from"), cut.alias("to")), F.struct(cut.alias("from"), F.col("b").alias("to")))).alias("half")
        again = held.join(wide, GROUP, "left_semi").select("word", "l", halves).select("word", "l", F.col("half.from").alias("a"), F.col("half.to").alias("b"))
        dealt = written(again)
        discard(held, wide)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row of forms (word, form), by doubling."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        new = written(at.join(ahead, at["root"] == ahead["via"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        settled = new.where("moved").isEmpty()
        discard(at)
        at = new
        if settled:
            return at.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, spared: int = SPARED, times: int = TIMES, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    words = written(vocabulary(docs, least, count, spared))
    pairs = near_pairs(words.select("word"), most)
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    counted = both.join(words.select(F.col("word").alias("v"), F.col("n").alias("m")), "v")
    best = F.min(F.struct((-F.col("m")).alias("less"), "v"))  # the largest count, then the smallest word
    near = counted.groupBy("u").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = words.join(near, words["word"] == near["u"], "left")
    ahead = -F.col("best.less") >= times * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ahead, F.col("best.v")).alias("form"), F.when(ahead, -F.col("best.less")).alias("form_n")))
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir) -> DataFrame:
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE bit(v, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM bit WHERE k = 8),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
occ AS (SELECT w, length(w) AS len, count(*) AS n, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', w))) AS x FROM run WHERE length(w) >= 6 GROUP BY doc_id, w),
crc AS (SELECT w, len, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS h FROM occ, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % len) || substr(w, h % len + 2) ELSE w END AS word, n FROM crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM v),
one AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM less),
pair AS (
  SELECT p.word AS u, q.word AS v, q.n AS m FROM one p JOIN one q ON p.i = q.i AND p.rest = q.rest AND p.word <> q.word
  UNION SELECT p.word, v.word, v.n FROM one p JOIN v ON p.rest = v.word
  UNION SELECT v.word, p.word, p.n FROM one p JOIN v ON p.rest = v.word),
near AS (SELECT u, count(*) AS n_near, first(v ORDER BY m DESC, v) AS form, max(m) AS form_n FROM pair GROUP BY u),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM v LEFT JOIN near ON word = u),
way(word, reached) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.reached = f.word WHERE f.form IS NOT NULL),
ended AS (SELECT way.word, reached AS root FROM way JOIN f ON reached = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ended ON f.word = ended.word
"""
