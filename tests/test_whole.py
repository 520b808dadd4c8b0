"""Queries that take the whole of their tables, against brute force on small fixtures that a cut would get wrong."""

import random

import numpy as np
import pandas as pd

from scorelake import registry
from scorelake.functions import algorithms
from scorelake.operators import joins


def saved(path, **tables):
    for name, frame in tables.items():
        pd.DataFrame(frame).to_parquet(path / f"{name}.parquet")
    return str(path)


def test_edit_distances_equal_brute_force():
    rng = random.Random(3)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    patterns = ["", "a", *(make(n, "abñ") for n in (3, 63, 64, 65, 128, 129, 200)), make(90, "語日本a"), make(1500, "abc")]
    texts = ["", "b", *(make(n, "abcñ") for n in (5, 64, 100, 180)), make(70, "語日x"), make(40, "ab") + patterns[-1][:1400]]
    p, q = map(list, zip(*[(i, j) for i in range(len(patterns)) for j in range(len(texts))], strict=True))
    want = [joins.levenshtein(patterns[i], texts[j]) for i, j in zip(p, q, strict=True)]
    assert algorithms.edit_distances(patterns, texts, p, q).tolist() == want


def test_anls_best_compares_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    make = lambda n: " ".join("".join(rng.choice("abcdeñü") for _ in range(rng.randint(2, 7))) for _ in range(n))
    opening = make(20)
    docs = [opening + " " + make(30) for _ in range(4)] + [make(n) for n in (1, 3, 8, 40)] + ["", "Straße  ÀÉ\n" * 9]
    items = [docs[2] + " x", docs[1][:-9], make(25), docs[-1].upper(), ""]
    sf = saved(tmp_path, documents={"doc_id": range(len(docs)), "text": docs}, benchmark={"item_id": range(len(items)), "text": items})
    plain = lambda x: " ".join(x.lower().split())
    dist = lambda x, y: joins.levenshtein(plain(x), plain(y)) / max(len(x.upper()), len(y.upper()), 1)
    want = {k: min((dist(x, y), i) for i, y in enumerate(docs)) for k, x in enumerate(items)}
    got = {r["item_id"]: (r["dist"], r["doc_id"]) for r in registry.QUERIES["anls_best"](spark, sf).collect()}
    assert got == {k: (round(d, 6), i) for k, (d, i) in want.items()}
    assert got[0][1] == 2 and got[1][1] == 1


def test_sequence_metrics_take_every_word(spark, tmp_path):
    pairs = [("a b c d e f g", "a b c d e f x"), ("a b c d e f", "a b c d e f g h"), ("a b c d e f g h", "a b c d e f g h"), ("a", "b")]
    turns = [{"conv_id": k, "turn": i, "role": ("user", "assistant")[i], "text": x} for k, p in enumerate(pairs) for i, x in enumerate(p)]
    got = {r["conv_id"]: (r["equality"], r["accuracy"], r["prefix_ratio"]) for r in registry.QUERIES["sequence_metrics"](spark, saved(tmp_path, conversations=turns)).collect()}
    assert got == {0: (0.0, round(6 / 7, 6), round(6 / 7, 6)), 1: (0.0, 0.0, 1.0), 2: (1.0, 1.0, 1.0), 3: (0.0, 0.0, 0.0)}


def test_page_attribute_edit_takes_whole_paragraphs(spark, tmp_path):
    a, b = "x" * 70 + "abcñ", "x" * 70 + "dé"
    html = [f"<p>{a}</p><p>{b}</p>", f'<p class="a>b">one\n{a}</p\n><P id=k>two <b>{b}</b></P><pre>no</pre>', "<p>a\nb</p>"]
    lines = [[a, b], ["one\n" + a, "two " + b], ["a\nb"]]
    sf = saved(tmp_path, pages={"page_id": range(3), "html": html})
    want = {}
    for k, l in enumerate(lines):
        pairs = list(zip(l, [*l[1:], ""], strict=True))
        want[k] = (1, round(sum(joins.levenshtein(x, y) for x, y in pairs) / sum(max(len(x), len(y)) for x, y in pairs), 6))
    assert {r["attribute"]: (r["pages"], r["edit"]) for r in registry.QUERIES["page_attribute_edit"](spark, sf).collect()} == want


def test_line_assignment_takes_all_lines(spark, tmp_path):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcñ") for _ in range(rng.randint(1, 90))) for _ in range(15)]
    long = "x" * 60
    pages = [[*names, long + "a"], [*names[::-1], long + "b"], names[:14]]
    html = ["".join(f'<a href="/{i}">{x}</a>' for i, x in enumerate(p)) for p in pages]
    got = registry.QUERIES["line_assignment"](spark, saved(tmp_path, pages={"page_id": range(3), "html": html})).collect()
    first = sorted((r["target"], r["pred"], r["edit"]) for r in got if r["page"] == 0)
    assert first == sorted([(x, x, 0.0) for x in names] + [(long + "a", long + "b", 1 / 61)])
    second = [r for r in got if r["page"] == 1]
    assert len(second) == 16 and sum(r["pred"] == "" and r["edit"] == 1.0 for r in second) == 2


def test_frechet_takes_every_component(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 11))
    x[30:, :8] = x[:30, :8]
    x[30:, 8:] = x[:30, 8:] + [0, 0, 3]  # only the mean of the eleventh differs
    sf = saved(tmp_path, embeddings={"label": [0] * 30 + [1] * 30, "embedding": x.tolist()})
    got = {r["label"]: r["distance"] for r in registry.QUERIES["frechet_by_label"](spark, sf).collect()}
    assert abs(got[0]) < 1e-5 and abs(got[1] - 9) < 1e-5


def draw(*parts, n):
    total = 12345
    for p in parts:
        total = (total * 1103515245 + p * 12820163 + 12345) % 2147483647
    return ((total // 65536) * 31 + total) % n


def rated(path):
    rng = random.Random(9)
    docs = [{"doc_id": i * 7 + 3, "text": "", "lang": "ab"[i % 3 == 0], "source": "s"} for i in range(30)]
    labels = [{"doc_id": d["doc_id"], "quality": rng.randint(0, 1), "toxic": int(rng.random() < 0.4)} for d in docs]
    rows = [(d["lang"], d["doc_id"], float(x["quality"] == x["toxic"])) for d, x in zip(docs, labels, strict=True)]
    return saved(path, documents=docs, labels=labels), [[r[1:] for r in rows if r[0] == lang] for lang in "ab"]


def test_bootstrap_takes_a_thousand_resamples(spark, tmp_path):
    sf, strata = rated(tmp_path)
    means = [np.mean([np.mean([s[draw(s[0][0], k, i, n=len(s))][1] for i in range(len(s))]) for s in strata]) for k in range(1000)]
    r = registry.QUERIES["bootstrap_ci"](spark, sf).first()
    assert [r["mean"], r["low"], r["high"]] == [round(float(x), 6) for x in (np.mean(means), np.quantile(means, 0.025), np.quantile(means, 0.975))]


def test_permutation_takes_ten_thousand_relabellings(spark, tmp_path):
    sf, strata = rated(tmp_path)
    gap = lambda a, b: sum(a) / len(a) - sum(b) / len(b)
    seen = round(np.mean([gap([v for i, v in s if i % 2 == 0], [v for i, v in s if i % 2]) for s in strata]), 9)
    hits = 0
    for k in range(10000):
        each = []
        for s in strata:
            v, n = [x for *_, x in sorted((draw(k, i, n=2147483647), i, x) for i, x in s)], sum(i % 2 == 0 for i, _ in s)
            each.append(gap(v[:n], v[n:]))
        hits += abs(round(np.mean(each), 9)) >= abs(seen)
    r = registry.QUERIES["permutation_test"](spark, sf).first()
    assert (round(r["observed"], 9), r["p"]) == (seen, round(hits / 10000, 6)) and 0 < hits < 10000


def test_resume_takes_every_label(spark, tmp_path):
    sf = saved(tmp_path, documents={"doc_id": range(6), "text": ["x"] * 6}, labels={"doc_id": [1, 2, 3, 3, 4], "quality": [1, 0, 0, 1, 1], "toxic": [0] * 5})
    got = {r["doc_id"]: (r["result"], r["todo"]) for r in registry.QUERIES["resume_anti_join"](spark, sf).collect()}
    assert got == {0: (None, True), 1: (1, False), 2: (0, False), 3: (1, False), 4: (1, False), 5: (None, True)}


def test_history_takes_every_turn(spark, tmp_path):
    roles = ["user", "assistant", "assistant", "user", "user", "user", "assistant"]
    turns = [{"conv_id": 4, "turn": i, "role": r, "text": f"t{i}"} for i, r in enumerate(roles)]
    got = registry.QUERIES["history_islands"](spark, saved(tmp_path, conversations=turns)).collect()
    want = [(0, "user", "t0", 1), (1, "assistant", "t1 t2", 2), (2, "user", "t3 t4 t5", 3), (3, "assistant", "t6", 1)]
    assert sorted((r["island"], r["role"], r["text"], r["n"]) for r in got) == want
