"""Typed table values against golden vectors, colours and charts against published pairs and brute force."""

import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import colours as C, values as V
from scorelake.operators import charts


def told(spark, column, vectors):
    """(vector, what the column makes of it) for all vectors in one plan; their last place is what is wanted."""
    rows = [(i, *v[:-1]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "i int, a string, b string" if len(rows[0]) == 3 else "i int, a string")
    got = {r["i"]: r["v"] for r in df.select("i", column.alias("v")).collect()}
    return [(v, got[i]) for i, v in enumerate(vectors)]


TEXTS = [("Café [1] (x) [b] (y)", "cafe"), ('"Élan"†', "elan"), (" ﬁne½ ‘q’ ", "fine1⁄2 'q'"), ("[1]", ""), ("[a]", "[a]"), ("(a)", "(a)"), ("“Hi.” [note]", "hi"), ("a..", "a."), ("x´y", "x y"), ("a \n b", "a b"), ("9 − 4‑2", "9 - 4-2"), ("", ""), ("*" * 5000, ""), ("a" + " (b) [c]" * 300, "a"), ('""a""', '""a""')]


def test_table_text(spark):
    for v, got in told(spark, V.table_text(F.col("a")), TEXTS):
        assert got == v[-1], v


def bare(x):
    """What stands behind a text, and quotation marks around it, taken off round by round."""
    import re

    while True:
        before, x = x, x.strip(" ")
        x = re.sub(r"(?:(?<!^)\[[^\]]*\]|\[\d+\]|[*#])*+\Z", "", x, count=1).strip(" ")
        x = re.sub(r"(?<!^)(?: \([^)]*\))*+\Z", "", x, count=1).strip(" ")
        x = re.sub(r'^"([^"]*)"\Z', r"\1", x)
        if x == before:
            return x


def test_table_text_by_rounds(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice('a1[]()" *#') for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for v, got in told(spark, V.table_text(F.col("a")), [(x, " ".join(bare(x).split())) for x in texts]):
        assert got == v[-1], v


def test_table_text_of_many_marks(spark):
    began = time.perf_counter()
    (_, got), (_, notes) = told(spark, V.table_text(F.col("a")), [("ab*** " * 8000, None), ("a" + " (b) [c]" * 8000, None)])
    assert got == "ab*** " * 7999 + "ab" and notes == "a"
    assert time.perf_counter() - began < 20


VALUES = [("3.0000001", ("number", 3.0, None)), ("2.9999999", ("number", 2.0, None)), ("-0.0", ("number", 0.0, None)), ("\n1_000 ", ("number", 1000.0, None)), ("1997-3-xx", ("date", None, [1997, 3, -1])), ("XX-12-31", ("date", None, [-1, 12, 31])), ("1997-xx-xx", ("number", 1997.0, None)), ("xx-xx-xx", ("text", None, None)), ("1997-13-1", ("text", None, None)), ("1997-1-32", ("text", None, None)), ("1-2", ("text", None, None)), ("1e400", ("text", None, None)), ("nan", ("text", None, None)), ("", ("text", None, None)), (None, None)]


def test_value(spark):
    for v, got in told(spark, V.value(F.col("a")), VALUES):
        assert (got and (got["kind"], got["amount"], got["date"])) == v[-1], v


DENOTATIONS = [("3|a", "A [1]|3.0", True), ("3||a", "a|3", True), ("3", "3.0|3", True), ("3|4", "3", False), ("1997-3-1", "1997-03-01", True), ("1997-3-1", "1997-3-2", False), ("b\\pc", "b\\pc", True), ("b|c", "b\\pc", False), ("", "", True), ("3", "(3)", False), ("1997", "1997-xx-xx", True), ("2.0000000001", "2", True), (None, "a", False)]


def test_same_denotation(spark):
    for v, got in told(spark, V.same_denotation(V.denotation(F.col("a")), V.denotation(F.col("b"))), DENOTATIONS):
        assert got is v[-1], v


AMOUNTS = [("$3,852 million", "3852", (False, True)), ("3852000000 dollars", "$3,852 million", (True, True)), ("34.2%", "0.342", (True, True)), ("34.2 %", "34.2", (False, True)), ("5 miles", "(5)", (True, True)), ("nan", "nan", (False, False)), ("inf", "Infinity", (True, True)), ("October 31", "october 31.", (True, True)), ("a million", "a", (False, True)), ("x", "y", (False, False)), (None, "1", (False, False)), ("1 thousandth", "1", (False, False))]


def test_same_amount(spark):
    for v, got in told(spark, V.same_amount(V.amount(F.col("a")), V.amount(F.col("b"))), AMOUNTS):
        assert tuple(got) == v[-1], v


# Published pairs of L*a*b* colours and their CIEDE2000 difference.
PAIRS = [
    (50, 2.6772, -79.7751, 50, 0, -82.7485, 2.0425), (50, 3.1571, -77.2803, 50, 0, -82.7485, 2.8615), (50, -1.3802, -84.2814, 50, 0, -82.7485, 1.0),
    (50, 0, 0, 50, -1, 2, 2.3669), (50, 2.49, -0.001, 50, -2.49, 0.0009, 7.1792), (50, 2.49, -0.001, 50, -2.49, 0.0011, 7.2195), (50, -0.001, 2.49, 50, 0.0009, -2.49, 4.8045),
    (50, -0.001, 2.49, 50, 0.0011, -2.49, 4.7461), (50, 2.5, 0, 50, 0, -2.5, 4.3065), (50, 2.5, 0, 73, 25, -18, 27.1492), (50, 2.5, 0, 61, -5, 29, 22.8977),
    (50, 2.5, 0, 56, -27, -3, 31.9030), (50, 2.5, 0, 58, 24, 15, 19.4535), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (35.0831, -44.1164, 3.7933, 35.0232, -40.0716, 1.5901, 1.8645), (90.8027, -2.0831, 1.4410, 91.1528, -1.6435, 0.0447, 1.4441), (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_colour_difference(spark):
    df = spark.createDataFrame([tuple(map(float, p)) for p in PAIRS], "l double, a double, b double, m double, c double, d double, want double")
    p, q = F.struct("l", "a", "b"), F.struct(F.col("m").alias("l"), F.col("c").alias("a"), F.col("d").alias("b"))
    for r in df.select("want", C.difference(p, q).alias("x"), C.difference(q, p).alias("y")).collect():
        assert r["x"] == pytest.approx(r["want"], abs=1e-4) and r["y"] == pytest.approx(r["want"], abs=1e-4)


def test_colour_texts(spark):
    red = told(spark, C.lab(F.col("a")), [("#ff0000", None)])[0][1]
    assert tuple(red) == pytest.approx((53.24, 80.09, 67.20), abs=0.02)
    for v, got in told(spark, C.likeness(F.col("a"), F.col("b")), [("#fFffff", "#FFFFFF", 1.0), ("#000000", "#ffffff", 0.0), ("viridis", "viridis", 1.0), ("red", "#ff0000", 0.0), ("a", "b", 0.0), ("#zz0000", "#ff0000", 0.0), (None, "a", 0.0)]):
        assert got == pytest.approx(v[-1], abs=1e-3), v


def test_consumed(spark):
    rng = random.Random(5)
    sides = [[(k, rng.choice(["a", "b", None])) for k in range(20) for _ in range(rng.randrange(5))] for _ in range(2)]
    got = {r["k"]: (r["preds"], r["targets"], r["hits"]) for r in charts.consumed(*[spark.createDataFrame(s, "k int, text string") for s in sides], ["k"], ["text"]).collect()}
    for k in range(20):
        t, p = ([x for n, x in s if n == k] for s in sides)
        n = (len(p), len(t))
        hits = sum(1 for x in t if x in p and not p.remove(x))
        assert got.get(k, (0, 0, 0)) == (*n, hits)


def test_consumed_near(spark):
    rng = random.Random(6)
    item = lambda: (rng.choice("ab"), float(rng.randrange(30)), float(rng.randrange(30)))
    rows = [(i, [item() for _ in range(rng.randrange(7))], [item() for _ in range(rng.randrange(7))]) for i in range(40)]
    kind = "array<struct<text:string,x:double,y:double>>"
    df = spark.createDataFrame(rows, f"i int, t {kind}, p {kind}")
    got = {r["i"]: r["n"] for r in df.select("i", charts.consumed_near(F.col("t"), F.col("p"), charts.placed_text()).alias("n")).collect()}
    for i, t, p in rows:
        hits = 0
        for a in t:
            near = [b for b in p if a[0] == b[0] and abs(a[1] - b[1]) <= 10 and abs(a[2] - b[2]) <= 10]
            if near:
                p.remove(near[0])
                hits += 1
        assert got[i] == hits


def permuted(score, a, b):
    """Largest sum of scores of one-to-one pairs, by trying all."""
    if len(a) > len(b):
        return permuted(lambda x, y: score(y, x), b, a)
    return max(sum(score(x, y) for x, y in zip(a, own, strict=True)) for own in itertools.permutations(b, len(a))) if a else 0.0


def test_colour_scores(spark):
    rng = random.Random(7)
    made = lambda k, most: [(k, rng.choice(["bar", "line"]), rng.choice(["#%06x" % rng.randrange(1 << 24), "named"]), i) for i in range(rng.randrange(most))]
    sides = [[x for k in range(12) for x in made(k, 5)] + [(50, "bar", f"#{v:02x}0000", v) for v in range(0, 240, 20)] for _ in range(2)]
    frames = [spark.createDataFrame(s, "k int, kind string, colour string, place int") for s in sides]
    got = {r["k"]: r for r in charts.colour_scores(*frames, ["k"]).collect()}
    texts = sorted({x[2] for s in sides for x in s})
    near = {v[:2]: x for v, x in told(spark, C.likeness(F.col("a"), F.col("b")), [(a, b, None) for a in texts for b in texts])}
    for k in {x[0] for s in sides for x in s}:
        own = []
        for s in sides:
            first = list(dict.fromkeys(x[1:3] for x in s if x[0] == k))
            kept = []
            for x in first:
                if len(first) <= 10 or all(near[x[1], y[1]] <= 0.7 for y in kept):
                    kept.append(x)
            own.append(kept)
        total = sum(permuted(lambda x, y: near[x, y], *[[c for t, c in o if t == kind] for o in own]) for kind in ("bar", "line"))
        assert got[k]["total"] == pytest.approx(total) and (got[k]["targets"], got[k]["preds"]) == tuple(map(len, own))
        assert got[k]["precision"] == pytest.approx(total / len(own[1]) if own[1] else 0.0)
    assert got[50]["targets"] < 12


def test_cluster_scores(spark):
    rng = random.Random(8)
    made = lambda: [(k, rng.choice(["a", "b", "c", None]), float(s := rng.randrange(20)), float(s + rng.randrange(8))) for k in range(10) for _ in range(rng.randrange(8))]
    sides = [made(), made()]
    got = {r["k"]: (r["clusters"], r["score"]) for r in charts.cluster_scores(*[spark.createDataFrame(s, "k int, cluster string, start double, end double") for s in sides], ["k"]).collect()}

    def overlap(a, b):
        hull = max(a[1], b[1]) - min(a[0], b[0])
        return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / hull if hull > 0 else 0.0

    def score(g, p):
        return math.sqrt(sum(max(overlap(a, b) for b in p) for a in g) / len(g) * max(0.0, 1 - abs(len(p) - len(g)) / len(g)))

    for k in range(10):
        g, p = ([[x[2:] for x in s if x[0] == k and x[1] == c] for c in ("a", "b", "c", None) if any(x[:2] == (k, c) for x in s)] for s in sides)
        assert got.get(k) == ((len(g), pytest.approx(permuted(score, g, p) / len(g))) if g else None)


def test_box_clusters(spark):
    rng = random.Random(9)
    box = lambda: tuple(float(rng.randrange(12)) for _ in range(4))
    made = lambda: [(k, rng.choice("ab"), rng.randrange(3), *box()) for k in range(8) for _ in range(rng.randrange(10))]
    sides = [made(), made()]
    got = {r["k"]: r["score"] for r in charts.cluster_scores(*[spark.createDataFrame(s, "k int, cluster string, f int, x1 double, y1 double, x2 double, y2 double") for s in sides], ["k"], frame="f").collect()}

    def overlap(a, b):
        a, b = ((min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])) for v in (a, b))
        both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
        return both / union if union > 0 else 0.0

    def score(g, p):
        frames, total = {x[0] for x in g} | {x[0] for x in p}, 0.0
        for f in frames:
            a, b = (sorted(x[1:] for x in s if x[0] == f) for s in (g, p))
            n, found, m = len(a), 0.0, len(b)
            while a and b:
                s, i, j = max(((overlap(x, y), -i, -j) for i, x in enumerate(a) for j, y in enumerate(b)))
                found += s
                del a[-i], b[-j]
            total += math.sqrt(found / n * max(0.0, 1 - abs(m - n) / n)) if n else 0.0
        return total / len(frames)

    for k in range(8):
        g, p = ([[x[2:] for x in s if x[:2] == (k, c)] for c in "ab" if any(x[:2] == (k, c) for x in s)] for s in sides)
        assert got.get(k) == (pytest.approx(permuted(score, g, p) / len(g)) if g else None)


def test_colour_scores_of_many_charts(spark):
    """One shuffle; charts longer than a batch and keys that are null; the numbers of whole columns are those of the expressions."""
    rng = random.Random(8)
    rows = [(None if k % 7 == 0 else k, "ab"[rng.randrange(2)], f"#{rng.randrange(1 << 24):06x}", n) for k in range(60) for n in range(3)] + [(99, "a", f"#0000{n % 4:02x}", n) for n in range(60)]
    df = spark.createDataFrame(rows, "k int, kind string, colour string, place int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = charts.colour_scores(df, df, ["k"])
        got = {r["k"]: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert set(got) == {k for k, *_ in rows} and all(r["f1"] == pytest.approx(1) for r in got.values())
    texts = [*{c for _, _, c, _ in rows[:40]}, "#zz0000", "red"]
    pairs = [(a, b) for a in texts for b in texts]
    at = {x: n for n, x in enumerate(texts)}
    near = C.likenesses(*(np.array([at[x] for x in side]) for side in zip(*pairs, strict=True)), C.labs(texts), np.array([x.startswith("#") for x in texts]))
    for (v, want), x in zip(told(spark, C.likeness(F.col("a"), F.col("b")), [(a, b, None) for a, b in pairs]), near, strict=True):
        assert x == pytest.approx(want, abs=1e-9), v


@pytest.mark.parametrize("name", ["amount_match", "denotation_match"])
def test_equal_answers_are_read_once(name, spark, sf_dir):
    """Rows that say the same are counted before their texts are read."""
    from scorelake import registry

    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2


def test_marks_that_the_order_leaves_open_stand_as_the_rows_do(spark, tmp_path):
    import duckdb

    from scorelake.registry import ORACLE_SQL, QUERIES

    line = "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    late, early, below = (2, 20.0, 0.02, 0.02, "N"), (2, 6.0, 0.09, 0.0, "N"), (3, 32.0, 0.06, 0.03, "N")  # the first two are moved to one x
    rows = [(k, *x) for k, order in enumerate(([late, early, below], [early, late, below], [below, early, late])) for x in order]
    spark.createDataFrame(rows, line).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in QUERIES["placed_texts"](spark, str(tmp_path)).collect()}
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(c.execute(ORACLE_SQL["placed_texts"]).fetchall()) == {(0, 3, 2), (1, 3, 1), (2, 3, 1)}


def shuffled(spark):
    """Records that stages have shuffled so far."""
    gate = spark.sparkContext._gateway
    empty = gate.jvm.java.util.ArrayList
    stages = spark._jsc.sc().statusStore().stageList(empty(), False, False, gate.new_array(gate.jvm.double, 0), empty())
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_names_and_dates_that_match_alike_are_counted_as_one(spark, tmp_path):
    """3,000 lines of as many names and dates, and names that say what other fields may say, or nothing, against each line read by itself."""
    import datetime

    from scorelake.registry import QUERIES

    said = ["17", "0.05", "0.05 [1]", "17 (a) [2]", "1999-1-2", "1999-01-02", "2000-1-1", "a|b", "x|17", "Café", "a (b)", "name", "", None]
    names = [f"part {chr(97 + n // 676 % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n % 26)}" for n in range(3000)] + said
    begin = datetime.datetime(1990, 1, 1)
    line = lambda k, n, q=17.0, d=0.05, tax=0.02, flag="N": (k, q, d, tax, flag, "O", begin + datetime.timedelta(days=n))
    odd = range(3000, len(names))
    rows = [line(k, k, 17.0 + k % 2, flag="NR"[k % 2]) for k in range(3000)]
    rows += [line(k, n, q, d, tax, flag) for k in odd for n in (3288, 3652, 3653) for q, d, tax in ((17.0, 0.05, 0.02), (5.0, 0.05, 0.05), (2.0, 0.1, 0.0)) for flag in "NR"]
    rows += [line(0, n, q, d, tax, flag) for n, (q, d, tax) in enumerate(((None, 0.05, 0.02), (17.0, None, 0.02), (17.0, 0.05, None))) for flag in "NR"]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    before = shuffled(spark)
    got = {tuple(r) for r in QUERIES["denotation_match"](spark, str(tmp_path)).collect()}
    assert shuffled(spark) - before < len(rows) - 2900
    x = spark.createDataFrame([(*r, names[r[0]]) for r in rows], "k long, q double, d double, tax double, flag string, status string, day timestamp, name string")
    target = "concat(bigint(q), '|', d, '|', tax, '|', date_format(day, 'yyyy-MM-dd'), '|', name)"
    pred = """concat('"', upper(name), '" (part)[1]||', date_format(day, 'yyyy-M-d'), format_string('||%.2f||%.3f', q, tax), if(flag = 'R', '', format_string('||%.3f', d)))"""
    sets = x.select("flag", "status", V.denotation(F.expr(target)).alias("t"), V.denotation(F.expr(pred)).alias("p"))
    want = sets.groupBy("flag", "status").agg(F.count("*"), F.sum(F.size("t")), F.sum(V.same_denotation(F.col("p"), F.col("t")).cast("long")))
    assert got == {tuple(r) for r in want.collect()}


APART = [("a bc", "A BC [1]", True), ('"A" (part)[1]', "a", True), ("a", "b", False), ("17 [1]", "17 [2]", False), ("①", "1.", False), ("1997-3-1.", "1997-3-1.", False), ("NaN", "nan", False), ("a|b", "a|b", False), ("a\\pb", "a\\pb", False), ("xx-xx-xx", "xx-xx-xx", True), ("", "", True), (None, "a", False)]


def test_apart(spark):
    for v, got in told(spark, V.apart(F.col("a"), F.col("b")), APART):
        assert got is v[-1], v
