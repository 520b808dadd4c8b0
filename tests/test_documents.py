"""Line matching, windows of words, orders and polygons against plain versions of their definitions."""

import itertools
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.functions import geometry, orders
from scorelake.operators import documents, passages, spotting
from scorelake.operators.joins import assignment, levenshtein


def make(r, n, letters="abcde "):
    return "".join(r.choice(letters) for _ in range(n)).strip()


def test_stretches_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        line = make(r, r.randint(0, 40))
        k = r.randint(0, max(len(line) - 1, 0))
        piece = r.choice([make(r, r.randint(0, 12)), line[k : k + 9], line[k : k + 4] + "x" + line[k + 5 : k + 12]])
        for share, strictly in ((0.6, False), (0.6, True), (0.4, True)):
            n = len(piece)
            near = [levenshtein(piece, line[i : i + n]) / n for i in range(len(line) - n + 1)] if n and n <= len(line) else []
            want = any(d < share if strictly else d <= share for d in near)
            assert documents.stretch_within(piece, line, share, strictly) is want, (piece, line)


def plain_match(targets, preds):
    """The three stages again, step by step, every distance in full."""
    far = lambda a, b: levenshtein(a, b) / max(len(a), len(b), 1)
    window = lambda piece, line: min((levenshtein(piece, line[i : i + len(piece)]) / len(piece) for i in range(len(line) - len(piece) + 1)), default=9) if piece else 9
    cost = np.array([[far(a, b) for b in preds] for a in targets])
    shut_t, shut_p = {i for i, j in zip(*np.where(cost < 0.25), strict=True)}, {j for i, j in zip(*np.where(cost < 0.25), strict=True)}
    picks = []
    for i, target in enumerate(targets):
        options = []
        for j in range(len(preds)):
            if i in shut_t or j in shut_p:
                continue
            run = [j]
            while (k := run[-1] + 1) < len(preds) and k not in shut_p:
                joined = " ".join(preds[x] for x in [*run, k])
                if far(target, joined) > far(target, " ".join(preds[x] for x in run)) or any(window(preds[x], target) > 0.6 for x in run) or window(preds[k], target) >= 0.6:
                    break
                run.append(k)
                if len(joined) > len(target):
                    break
            options.append((far(target, " ".join(preds[x] for x in run)), run))
        if options:
            picks.append(min(options, key=lambda o: o[0]))
    runs = documents.consistent([(tuple(run), c) for c, run in picks])
    lines = sorted(runs + [(j,) for j in range(len(preds)) if not any(j in run for run in runs)])
    text = [" ".join(preds[j] for j in run) for run in lines]
    pairs = assignment(np.array([[far(a, b) for b in text] for a in targets]))
    groups = {lines[c]: [i] for i, c in pairs if far(targets[i], text[c]) <= 0.7}
    taken = {i for own in groups.values() for i in own}
    left = [i for i in range(len(targets)) if i not in taken]
    for j in range(len(preds)):
        near = [i for i in left if window(targets[i], preds[j]) < 0.4]
        if near:
            groups.setdefault((j,), []).extend(i for i in near if i not in taken)
            taken |= set(near)
    rows = []
    for run, own in groups.items():
        if len(own) == 1:
            rows.append(((own[0],), run, far(targets[own[0]], " ".join(preds[j] for j in run))))
        elif own:
            rows.append((tuple(sorted(own)), run, far("".join(targets[i] for i in sorted(own)), preds[run[0]])))
    return rows


def test_matching_equals_the_plain_version():
    r = random.Random(7)
    seen = Counter()
    for _ in range(150):
        targets = [make(r, r.randint(1, 26)) or "a" for _ in range(r.randint(2, 5))]
        preds = []
        for t in targets:
            k = r.randint(0, 9)
            if k < 3 and len(t) > 6:
                c = r.randint(2, len(t) - 2)
                preds += [t[:c].strip() or "b", t[c:].strip() or "b"]
            elif k < 5 and preds:
                preds[-1] += t
            elif k < 9:
                preds.append("".join(x if r.random() < 0.85 else "e" for x in t))
        preds = preds or ["zz"]
        if len(targets) * len(preds) == 1:
            continue
        cost = np.array([[levenshtein(a, b) / max(len(a), len(b), 1) for b in preds] for a in targets])
        got = documents.matched(targets, preds, cost)
        want = plain_match(targets, preds)
        assert {(tuple(a), tuple(b), round(e, 9)) for a, b, e in got if a and b and e < 1} == {(a, b, round(e, 9)) for a, b, e in want if e < 1}
        assert sorted(i for a, _, _ in got for i in a) == list(range(len(targets)))
        seen.update((len(a) > 1, len(b) > 1) for a, b, _ in got)
    assert seen[True, False] and seen[False, True]


def test_quick_match_of_pages(spark):
    a, b, c = "the first long line of a page", "a second line that is longer than the first", "third"
    rows = [
        (1, [a, b, c], [a, b[:20].strip(), b[20:].strip(), c]),
        (2, [a, c], [f"{a}{c}"]),
        (3, [a], None),
        (4, None, [a, c]),
        (5, [a], ["x" * 9]),
        (6, [], []),
        (7, [a, None], ["", a]),
        (8, [a, "zzzz"], [a, "qqqqqqq", "w"]),
    ]
    df = spark.createDataFrame(rows, "page long, targets array<string>, preds array<string>").withColumn("edit", F.lit("clash"))
    got = {}
    for r in documents.quick_match(df).collect():
        got.setdefault(r["page"], []).append((tuple(r["targets"]), tuple(r["preds"]), round(r["edit"], 4)))
    got = {k: sorted(v) for k, v in got.items()}
    assert got[1] == [((0,), (0,), 0.0), ((1,), (1, 2), got[1][1][2]), ((2,), (3,), 0.0)] and got[1][1][2] < 0.05
    assert got[2] == [((0, 1), (0,), 0.0)]
    assert got[3] == [((0,), (), 1.0)] and got[4] == [((), (0,), 1.0), ((), (1,), 1.0)]
    assert got[5] == [((0,), (0,), 1.0)] and 6 not in got
    assert got[7] == [((0,), (1,), 0.0), ((1,), (0,), 0.0)]
    assert got[8] == [((0,), (0,), 0.0), ((1,), (2,), 1.0)]  # the nearer of two spare lines
    assert documents.quick_match(df.where("page < 0")).count() == 0


def test_runs_that_clash():
    assert documents.consistent([((0, 1), 0.2), ((1, 2), 0.1), ((4,), 0.9)]) == [(1, 2), (4,)]
    assert documents.consistent([((0, 1), 0.4), ((1, 2), 0.9), ((2, 3), 0.2)]) == [(0, 1), (2, 3)]
    assert documents.consistent([]) == []


def plain_moves(gt, pred):
    pred, cost = list(pred), 0
    if len(gt) != len(pred) or not gt or set(gt) - set(pred):
        return None
    for i, want in enumerate(gt):
        if pred[i] != want:
            at = pred.index(want)
            cost += abs(i - at)
            if at < i:
                pred[i], pred[at] = pred[at], pred[i]
    return cost / len(gt)


def test_orders(spark):
    r = random.Random(4)
    rows = [([1, 2, 3], [2, 1, 3]), ([], []), ([1], []), ([], [1, 2]), ([1, 2], [1, 3]), (None, [1]), ([None, 1], [1, None])]
    rows += [(list(range(n)), r.sample(range(n), n)) for n in (2, 3, 5, 8, 8, 9)]
    rows += [([r.randint(0, 3) for _ in range(r.randint(0, 7))], [r.randint(0, 3) for _ in range(r.randint(0, 7))]) for _ in range(60)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, gt array<int>, pred array<int>")
    got = df.select("k", orders.order_edit(F.col("gt"), F.col("pred")), orders.move_distance(F.col("gt"), F.col("pred"))).collect()
    for k, edit, moved in got:
        gt, pred = rows[k]
        if gt is None or pred is None:
            assert edit is None and moved is None
            continue
        assert edit == (levenshtein(gt, pred) / max(len(gt), len(pred)) if gt or pred else None)
        if None not in gt:
            assert moved == plain_moves(gt, pred), (gt, pred)
    assert next(m for k, _, m in got if k == 0) == pytest.approx(2 / 3)


def plain_window(words, needle, asked, allowed):
    best = (0.0, -1)
    for s in range(len(words) - len(asked) + 1):
        w = words[s : s + len(asked)]
        if asked and set(w) & allowed:
            v = SequenceMatcher(None, " ".join(w), needle).ratio()
            if v > best[0]:
                best = (v, s)
    return best


def test_best_windows(spark):
    r = random.Random(6)
    words = ["alpha", "beta", "betas", "gamma", "delta", "alphas", "the", "a", "of"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    hay = [(k % 4, k, text(r.randint(0, 40))) for k in range(12)] + [(1, 90, None), (2, 91, "")]
    needles = [(k % 5, k, text(r.randint(1, 6))) for k in range(10)] + [(1, 70, None), (1, 71, "!? zzz"), (2, 72, text(60))]
    h = spark.createDataFrame(hay, "key int, h int, text string").withColumn("n", F.lit("clash"))
    n = spark.createDataFrame(needles, "key int, id int, needle string")
    got = {(x["h"], x["id"]): x for x in passages.best_windows(h, n, "h", "id", on=["key"]).collect()}
    assert set(got) == {(a[1], b[1]) for a in hay for b in needles if a[0] == b[0]}
    token = lambda t: __import__("re").findall(r"\w+|[^\w\s]", t or "")
    for (_, hid, ht), (_, nid, nt) in ((a, b) for a in hay for b in needles if a[0] == b[0]):
        asked, x = token(nt), got[hid, nid]
        v, s = plain_window(token(ht), nt or "", asked, set(asked))
        assert (x["likeness"], x["start"]) == (v, s if s >= 0 else None)
        if s >= 0:
            w = token(ht)[s : s + len(asked)]
            both, one, two = len(set(w) & set(asked)), len(set(w)), len(set(asked))
            assert (x["precision"], x["recall"], x["jaccard"], x["exact_match"]) == (both / one, both / two, both / (one + two - both), float(w == asked))
            assert x["rouge1"] == pytest.approx(2 * sum((Counter(w) & Counter(asked)).values()) / (len(w) + len(asked)))
        else:
            assert x["f1"] == x["rouge1"] == 0
    # by the rarest token, without a key
    held = Counter(t for _, _, ht in hay for t in set(token(ht)))
    want = {}
    for _, nid, nt in needles:
        known = sorted((held[t], t) for t in set(token(nt)) if held[t])
        for _, hid, ht in hay:
            v, s = plain_window(token(ht), nt or "", token(nt), {t for _, t in known[:1]})
            if s >= 0:
                want[hid, nid] = (v, s)
    met = passages.best_windows(h, n, "h", "id", rarest=1).collect()
    assert {(x["h"], x["id"]): (x["likeness"], x["start"]) for x in met} == want


def test_polygons(spark):
    r = random.Random(2)

    def convex():
        turns = sorted(r.uniform(0, 6.28) for _ in range(r.randint(3, 7)))
        x, y = r.uniform(2, 8), r.uniform(2, 8)
        p = [(float(x + 4 * np.cos(t)), float(y + 3 * np.sin(t))) for t in turns]
        return p if r.random() < 0.5 else p[::-1]

    def inside(p, x, y):
        side = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) for a, b in zip(p, p[1:] + p[:1], strict=True)]
        return np.all([s >= 0 for s in side], axis=0) | np.all([s <= 0 for s in side], axis=0)

    rows = [(k, convex(), convex()) for k in range(12)]
    df = spark.createDataFrame(rows, "k int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    x, y = np.meshgrid(np.arange(-3, 13, 0.02), np.arange(-3, 13, 0.02))
    for k, area, shared in df.select("k", geometry.polygon_area(F.col("a")), geometry.shared_area(F.col("a"), F.col("b"))).collect():
        a, b = rows[k][1:]
        assert area == pytest.approx(inside(a, x, y).sum() * 0.0004, abs=0.3)
        assert shared == pytest.approx((inside(a, x, y) & inside(b, x, y)).sum() * 0.0004, abs=0.3)
    odd = spark.sql("SELECT array(struct(0D AS x, 0D AS y)) AS a, cast(array() AS array<struct<x:double,y:double>>) AS b").select(geometry.polygon_area(F.col("a")), geometry.polygon_area(F.col("b"))).first()
    assert tuple(odd) == (0.0, 0.0)


def test_first_come_equals_one_by_one(spark):
    r = random.Random(5)
    pairs = sorted({(r.randint(0, 2), r.randint(0, 9), r.randint(0, 9)) for _ in range(90)})
    want, used = set(), set()
    for k, g, d in pairs:
        if not {(k, "g", g), (k, "d", d)} & used:
            used |= {(k, "g", g), (k, "d", d)}
            want.add((k, g, d))
    df = spark.createDataFrame(pairs, "k int, g int, d int")
    assert {tuple(x) for x in spotting.first_come(df, ["k"], "g", "d").collect()} == want
    assert spotting.first_come(df.where("k > 5"), ["k"], "g", "d").count() == 0


def test_spotting(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    targets = [(1, 0, box(0.0, 0.0, 10.0, 10.0), "Word."), (1, 1, box(200.0, 0.0, 20.0, 10.0), "###"), (1, 2, box(50.0, 50.0, 10.0, 10.0), "other"), (2, 0, box(0.0, 0.0, 4.0, 4.0), None), (4, 0, None, "x")]
    found = [(1, 0, box(1.0, 0.0, 10.0, 10.0), "wORD"), (1, 1, box(0.0, 0.0, 10.0, 10.0), "word."), (1, 2, box(201.0, 1.0, 4.0, 4.0), "gone"), (1, 3, box(52.0, 50.0, 10.0, 10.0)[::-1], "no"), (3, 0, box(0.0, 0.0, 1.0, 1.0), "a")]
    shape = "image int, {} int, polygon array<struct<x:double,y:double>>, text string"
    t, s = spark.createDataFrame(targets, shape.format("g")), spark.createDataFrame(found, shape.format("d"))
    for cell in (3.0, 64.0, 1000.0):
        got = {tuple(x) for x in spotting.spotting(t, s, ["image"], cell=cell).collect()}
        assert got == {(1, 2, 3, 2, 1), (2, 1, 0, 0, 0), (3, 0, 1, 0, 0), (4, 1, 0, 0, 0)}
    cases = list(itertools.product(["Word.", "(Word)", "Word", "", ".", "..", None], ["word", "WORD.", "", "."]))
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, s string")

    def plain(a, b):
        if a is None:
            return None
        a, b = a.upper(), b.upper()
        first, last = bool(a) and a[0] in spotting.MARKS, bool(a) and a[-1] in spotting.MARKS
        return a == b or first and a[1:] == b or last and a[:-1] == b or first and last and len(a) > 1 and a[1:-1] == b

    for k, same in frame.select("k", spotting.same_text(F.col("t"), F.col("s"))).collect():
        assert same == plain(*cases[k]), cases[k]


def test_patterns_side_by_side(spark, sf_dir, monkeypatch):
    from scorelake.functions import algorithms
    from scorelake.plans.documents import quick_match

    r = random.Random(11)
    make_text = lambda most: "".join(r.choice("ab é") for _ in range(r.randint(0, most)))
    for pack in (1, 64, algorithms.PACK):
        monkeypatch.setattr(algorithms, "PACK", pack)
        for _ in range(40):
            patterns, text = [make_text(80) for _ in range(r.randint(0, 6))], make_text(120)
            assert algorithms.distances_from(patterns)(text) == [levenshtein(p, text) for p in patterns]
    assert documents.costs([], ["a"]).shape == (0, 1) and documents.costs(["a"], []).shape == (1, 0)
    assert documents.costs(["", "ab", "ab"], ["", "a"]).tolist() == [[0, 1], [1, 0.5], [1, 0.5]]
    assert quick_match(spark, sf_dir).rdd.getNumPartitions() > 4  # a table of one file is no single task


def test_small_groups_take_no_rounds(spark, monkeypatch):
    r = random.Random(8)
    chain = [(0, i, j) for i in range(9) for j in (i, i + 1)]  # each pair waits for the one before it
    many = sorted({(1, r.randint(0, 40), r.randint(0, 40)) for _ in range(200)})
    want, used = set(), set()
    for k, g, d in chain + many:
        if not {(k, "g", g), (k, "d", d)} & used:
            used |= {(k, "g", g), (k, "d", d)}
            want.add((k, g, d))
    df = spark.createDataFrame(chain + many, "k int, g int, d int")
    assert {tuple(x) for x in spotting.first_come(df, ["k"], "g", "d").collect()} == want  # one group of each kind
    tables, own = [], spotting.written
    monkeypatch.setattr(spotting, "written", lambda t: tables.append(t) or own(t))
    assert {tuple(x) for x in spotting.first_come(df.where("k = 0"), ["k"], "g", "d").collect()} == {x for x in want if x[0] == 0}
    assert len(tables) == 2
    box = geometry.rectangle(F.lit(0.1), F.lit(0.2), F.lit(7.3), F.lit(3.3))
    turned = F.reverse(geometry.rectangle(F.lit(0.7), F.lit(-1.0), F.lit(9.0), F.lit(3.1)))
    got = spark.range(1).select(geometry.shared_area(box, turned), geometry.shared_area(turned, box), geometry.polygon_area(box)).first()
    assert tuple(got) == ((7.3 - 0.7) * (3.1 - 0.2), (7.3 - 0.7) * (3.1 - 0.2), (7.3 - 0.1) * (3.3 - 0.2))


def test_windows_deal_no_needle_and_no_hay_by_its_words(spark):
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    h = spark.createDataFrame([(1, k % 7, f"word{k % 5} of text {k % 3}.") for k in range(40)], "key int, h int, text string")
    n = spark.createDataFrame([(1, k, f"word{k} of") for k in range(4)] * 2, "key int, id int, needle string")
    found = lambda df: sorted((x["h"], x["id"], x["likeness"], x["start"]) for x in df.collect())
    for on in ([], ["key"]):
        got = passages.best_windows(h, n, "h", "id", on=on, rarest=1)
        assert "words#" not in "".join(x for x in text(got).splitlines() if "Aggregate [" in x)  # rows that repeat are told by id and digest
        assert found(got) == found(passages.best_windows(h.union(h), n.union(n), "h", "id", on=on, rarest=1)) != []


def test_windows_by_rarest_tokens_with_a_key(spark, monkeypatch):
    r = random.Random(12)
    text = lambda n: " ".join(f"w{min(r.randint(0, 30), r.randint(0, 30))}" for _ in range(n))
    hay = [(k % 4, k // 2 if k < 8 else k, text(r.randint(5, 30))) for k in range(16)]  # some ids have two texts
    hay += [(1, None, text(20)), (None, 60, text(20)), (2, 61, None), (2, 62, "")]
    needles = [(k % 5, k, text(r.randint(1, 5))) for k in range(20)] + [(1, None, "w1 w2"), (2, 80, None), (2, 81, "w99"), (None, 82, "w1"), (3, 0, "w0 w1")]
    h, n = spark.createDataFrame(hay, "key int, h int, text string"), spark.createDataFrame(needles, "key int, id int, needle string")
    held = Counter(t for x in set(hay) for t in set((x[2] or "").split()))
    told = []
    for rarest in (1, 2):
        want = Counter()
        for key, nid, needle in needles:
            asked = (needle or "").split()
            allowed = {t for _, t in sorted((held[t], t) for t in set(asked) if held[t])[:rarest]}
            for hkey, hid in {(a, b) for a, b, _ in hay}:
                if key is None or key != hkey:
                    continue
                some = [plain_window((t or "").split(), needle or "", asked, allowed) for a, b, t in hay if (a, b) == (hkey, hid)]
                some = [(v, s) for v, s in some if s >= 0 and None not in (nid, hid)] or [(0.0, None)]
                want.update((key, hid, nid, needle, v, s) for v, s in some)
        for frequent in (0, 5, passages.FREQUENT):
            monkeypatch.setattr(passages, "FREQUENT", frequent)
            got = passages.best_windows(h.union(h), n.union(n), "h", "id", on=["key"], rarest=rarest).collect()
            assert Counter((x["key"], x["h"], x["id"], x["needle"], x["likeness"], x["start"]) for x in got) == want
            told.append(sum(x["likeness"] > 0 for x in got))
        monkeypatch.undo()
    assert min(told) > 10


def test_windows_with_a_key_deal_no_tokens_of_hays_or_needles(spark):
    r = random.Random(13)
    text = lambda n: " ".join(f"w{r.randint(0, 40)}" for _ in range(n))
    h = spark.createDataFrame([(k, k, text(300)) for k in range(60)], "key int, h int, text string")
    n = spark.createDataFrame([(k % 300, k, text(20)) for k in range(1500)], "key int, id int, needle string")  # most keys have no hay
    sc = spark.sparkContext

    def dealt():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    old, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), dealt()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables beyond the size of a broadcast
    try:
        assert passages.best_windows(h, n, "h", "id", on=["key"], rarest=1).count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sum(v for k, v in dealt().items() if k not in before) < 60 * 300 / 2  # half the hays' words; the needles have 30,000
