"""The operators on small tables: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.llm import decontaminate, hnsw, html_extract, language_id, order_minhash, registry, ring, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from scorelake.llm.common import words

CLASH = "node string, spans int, shard int, key string, n int, rank int, score double, ring int, batch string"


def docs_frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(r.randint(60, 140)) for _ in range(12)]
    out = list(base)
    for b in base[:6]:  # near copies
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[r.randrange(len(v))] = word()
            out.append(" ".join(v))
    shared = text(55)
    out += [f"{text(80)} {shared} {text(80)}" for _ in range(6)]  # a long passage that repeats
    out += [base[0], base[0], None, None, "", "", "!!", "!!", "one two", "ab " * 3000, "x" * 5000, "\0 é"]
    return out


def brute_repeats(texts, size):
    seen, out = collections.Counter(), []
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[p : p + size] for p in range(len(d) - size + 1))
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - size + 1):
            if seen[d[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, f in zip(d, gone, strict=True) if not f)
        out.append((len(d), sum(gone), sum(f and (i == 0 or not gone[i - 1]) for i, f in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("size", "span"), [(200, 128), (24, 16)])
def test_suffix_dedup(spark, corpus, size, span):
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.digest(docs_frame(spark, corpus), size, span, 40).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_repeats(corpus, size)
    assert suffix_dedup.digest(docs_frame(spark, [])).count() == 0


def test_suffix_removal_keeps_columns(spark, corpus):
    df = docs_frame(spark, corpus)
    out = suffix_dedup.remove(df)
    assert out.columns == df.columns
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    want = brute_repeats(corpus, 200)
    for i, t in enumerate(corpus):
        assert left[i][0] is None if t is None else len(left[i][0].encode()) == want[i][0] - want[i][1]
        assert t is None or left[i][1] == len(left[i][0])


def brute_classes(texts):
    sh = order_minhash.Shingler()
    s = [None if t is None else tuple(sh(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            same = texts[i] == texts[j]
            if not same and s[i] and s[j]:
                same = order_minhash._by_diagonals(np.array(s[i], np.uint64), np.array(s[j], np.uint64), int((len(s[i]) + len(s[j])) / 9 + 1e-9))
            if same:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_order_minhash(spark, corpus):
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs_frame(spark, corpus)).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_classes(corpus)
    assert order_minhash.classes(docs_frame(spark, [])).count() == 0
    kept = order_minhash.dedup(docs_frame(spark, corpus))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(corpus)))
    twice = docs_frame(spark, ["a b c d e f g", "a b c d e f g", "q"], [5, 5, 6])
    assert sorted(r["doc_id"] for r in order_minhash.dedup(twice).collect()) == [5, 6]


def test_dedup_goes_by_row(spark):
    """Unlike texts under one doc_id stay, and copies go whether or not they have a doc_id."""
    one, two, three, four = "a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z"
    rows = [(1, one), (1, two), (2, one), (2, three), (None, four), (None, four), (None, one), (3, None), (3, None), (4, two), (1, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in order_minhash.dedup(df).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (2, three), (None, four), (3, None)], key=str)


def test_pairs_apart_from_the_bucket_leader_are_found(spark):
    """Nodes that share a bucket with a leader unlike them are still compared with each other."""
    a, b = "p q r s t u v w x y".split(), "k l m n o i j h g f".split()
    texts = [" ".join(a * 4), " ".join([*b * 4, "z"]), " ".join([*b * 4, "y"]), "e d c"]
    nodes = order_minhash.nodes_of(docs_frame(spark, texts)).select("node", "text").where("node is not null")
    rows = order_minhash.sketches(nodes).select(F.lit(7).alias("key"), "node", "n", "bits", F.when(F.col("n") == 36, 9).otherwise(1).alias("centre"), F.col("node").alias("class"))
    found = []
    for count in (1, 3):
        open_rows = order_minhash.opened(rows, False)
        lead = order_minhash.leaders(open_rows, count)
        found.append(order_minhash.verified(order_minhash.held_against(open_rows, lead), nodes).count())
        rows = rows.join(order_minhash.unheld(open_rows, lead), ["key", "node"])
    assert rows.count() == 0
    assert found == [0, 1]


@pytest.mark.parametrize("sure", [0, 1, 16])
def test_every_candidate_pair_is_decided(spark, monkeypatch, sure):
    """Classes are those of all pairs with a common band, also in buckets far larger than the leaders of the first rounds."""
    monkeypatch.setattr(order_minhash, "SURE", sure)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):  # copies of one passage with runs of words exchanged: some near, some not, most in common buckets
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            at, n = int(rng.integers(0, 54)), int(rng.integers(1, 7))
            w[at : at + n] = [f"x{int(rng.integers(0, 3))}" for _ in range(n)]
        texts.append(" ".join(w))
    shingle = order_minhash.Shingler()
    s = [shingle(v) for v in texts]
    keys = [set(order_minhash.sketch(v)) for v in s]
    label = list(range(len(texts)))
    apart = 0
    for i in range(len(s)):
        for j in range(i):
            if keys[i] & keys[j] or texts[i] == texts[j]:
                if order_minhash.aligned(s[j], s[i]):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
                else:
                    apart += 1
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs_frame(spark, texts)).collect()}
    assert apart and len(set(label)) > 1
    assert [got[i] for i in range(len(texts))] == label


def test_bitmap_bound_keeps_every_similar_pair(spark):
    r = random.Random(9)
    base = [r.randrange(1 << 20) for _ in range(120)]
    seqs = [base]
    for k in range(40):
        v = list(base)
        for _ in range(k // 4):
            v[r.randrange(len(v))] = r.randrange(1 << 20)
        seqs.append(v[: 120 - k % 7] + v[: k % 5])
    seqs = [np.array(v, np.uint64) for v in seqs]
    rows = [(i, len(v), order_minhash.bitmap(order_minhash.labelled(v))) for i, v in enumerate(seqs)]
    df = spark.createDataFrame(rows, "i int, n int, x array<long>")
    other = df.toDF("j", "m", "y")
    may = {tuple(p) for p in df.crossJoin(other).where(order_minhash.near(F.col("n"), F.col("m"), F.col("x"), F.col("y"))).select("i", "j").collect()}
    like = {(i, j) for i, a in enumerate(seqs) for j, b in enumerate(seqs) if order_minhash.aligned(a, b)}
    assert like <= may and len(like) > 100 and len(may) < len(seqs) ** 2


def test_equal_shingles_are_one_class_and_tables_go(spark):
    from scorelake.llm import common

    left = len(common.kept)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(docs_frame(spark, ["A b, c d e f", "a b c d e f!", "a b c d e g h i", None])).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    assert len(common.kept) == left + 1


def brute_decontaminate(texts, items, window):
    out = []
    for t in texts:
        w = words(t)
        hit, ids = [0] * len(w), set()
        for item_id, text in items:
            v = words(text)
            n = min(window, len(v))
            for a in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[a : a + n]:
                        hit[p : p + n] = [1] * n
                        ids |= {str(item_id)} if item_id is not None else set()
        out.append((len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), sum(hit) > 0))
    return out


@pytest.mark.parametrize("index_bytes", [1 << 20, 60])
def test_decontaminate(spark, corpus, index_bytes):
    texts = [*corpus, "So: a b C d-e f g h i j k, end", "a b c d e f g h i j", "Tiny item here", "tiny ITEM", "a b " * 30]
    items = [(1, "A b c d e f g h i j k"), (2, "tiny item"), (3, None), (4, "??"), (5, "a b a b a b a b a b a b"), (None, "h i j"), (2, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in decontaminate.find(docs_frame(spark, texts), bench, index_bytes=index_bytes).collect()}
    want = brute_decontaminate(texts, items, 10)
    assert [got[i] for i in range(len(texts))] == want
    clean = {r["doc_id"] for r in decontaminate.clean(docs_frame(spark, texts), bench, index_bytes=index_bytes).collect()}
    assert clean == {i for i, w in enumerate(want) if not w[4]}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs_frame(spark, texts), none).where("contaminated").count() == 0
    assert decontaminate.find(docs_frame(spark, []), bench).count() == 0


def test_tokens(spark, corpus):
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs_frame(spark, corpus)).collect()}
    ids = sentencepiece_codec.encode(docs_frame(spark, corpus), check=True)
    seen = {r["doc_id"]: r for r in ids.collect()}
    for i, t in enumerate(corpus):
        assert counts[i] == seen[i]["n_ids"] == len(seen[i]["ids"]) and seen[i]["lossless"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(ids).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(corpus))
    assert token_counts.count_tokens(docs_frame(spark, [])).count() == sentencepiece_codec.encode(docs_frame(spark, [])).count() == 0


def test_ring(spark, corpus):
    df = docs_frame(spark, corpus * 4, [None if i % 11 == 0 else i for i in range(4 * len(corpus))])
    out = ring.shard(df).toPandas()
    per = out.groupby("shard")["slot"].agg(["min", "max", "count"])
    assert len(out) == 4 * len(corpus) and (out["law"] == "rows").all() and out["grown_shard"].isna().all()
    assert (per["min"] == 0).all() and (per["max"] + 1 == per["count"]).all() and per["count"].max() - per["count"].min() <= 1
    want = collections.Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in corpus * 4)
    assert collections.Counter(zip(out["size"], out["text_crc32"], strict=True)) == want
    assert ring.shard(docs_frame(spark, [])).count() == 0
    slot = {r["doc_id"]: r["s"] for r in docs_frame(spark, ["a"] * 5).select("doc_id", ring.slot_of().alias("s")).collect()}
    assert slot == {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % ring.SLOTS for i in range(5)}


def test_neighbours(spark):
    r = np.random.default_rng(8)
    v = r.standard_normal((500, 8)).astype(np.float32)
    v[100:140] = v[100]  # copies: ties go to the smaller id
    rows = [(i, [float(x) for x in x]) for i, x in enumerate(v)] + [(1000, None), (1020, []), (1040, [0.0] * 8), (1060, [float("nan")] * 8), (1080, [float("inf")] + [1.0] * 7), (1100, [None] + [1.0] * 7), (1120, [1.0, 2.0]), (0, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("x"))
    got = collections.defaultdict(list)
    for x in hnsw.neighbours(df, shard_rows=100).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    assert set(got) == set(range(0, 500, 20))
    hits = 0
    for q, found in got.items():
        s = v.astype(float) @ v[q].astype(float)
        want = sorted((-s[j], j) for j in range(500) if j != q)[:20]
        hits += len({j for _, j in want} & {j for j, _ in found})
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert np.allclose([x for _, x in found], s[[j for j, _ in found]])
    assert hits / 20 / len(got) > 0.9
    copies = [j for j, _ in got[100] if 100 <= j < 140]
    assert copies == list(range(101, 101 + len(copies)))
    blocks = {(x["query_id"], x["vec_id"]): x["score"] for x in hnsw.neighbours(df, shard_rows=100, query_rows=3).collect()}
    assert blocks == {(q, j): x for q, found in got.items() for j, x in found}
    again = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [2.0, 3.0]), (2, [0.1, 0.2])], "vec_id long, embedding array<float>")
    best = [tuple(x) for x in hnsw.neighbours(again).orderBy("rank").collect()]
    assert [x[:3] for x in best] == [(0, 1, 1), (0, 2, 2)] and best[0][3] == 3.0  # an id is one candidate and one query
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in hnsw.neighbours(few).collect()] == [(0, 1, 1, 0.5)]
    assert hnsw.neighbours(few.where("vec_id < 0")).count() == 0


def test_html(spark):
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now.</div><article><h1>Head</h1><p>One &amp;  two<br>three.</p><p>Last one.</p></article><div class="comments"><p>Nice.</p></div><footer>&copy; x</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "<article>" + "<p>Some words here.</p>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df).orderBy("page_id").collect()]
    assert got[0] == (1, "Head\nOne & two three.\nLast one.", 31)
    assert got[1:4] == [(2, "", 0), (3, "", 0), (3, "", 0)] and got[4][2] == 3000 * 17 - 1
    assert html_extract.extract(df.where("page_id < 0")).count() == 0


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_toxicity_query(spark, tmp_path):
    r = random.Random(1)
    texts = [" ".join(r.choice(("calm", "river", "stone", "light", "green", "muslim")) for _ in range(20)) + (" scum idiot" if i % 4 == 0 else "") for i in range(200)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(0, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.query(spark, write(spark, tmp_path, documents=docs_frame(spark, texts), labels=labels)).toPandas().set_index("doc_id")
    assert len(out) == 202 and out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    assert all(out.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(202))
    held = out[out["held_out"] & (out.index < 200)]
    assert (held["predicted"] == (held.index % 4 == 0).astype(int)).all()
    none = toxicity.query(spark, write(spark, tmp_path / "none", documents=docs_frame(spark, texts), labels=labels.where("doc_id < 0"))).toPandas()
    assert (none["predicted"] == 0).all() and len(none) == 202
    assert toxicity.query(spark, write(spark, tmp_path / "empty", documents=docs_frame(spark, []), labels=labels)).count() == 0


def test_language_query(spark, tmp_path):
    sample = {"en": "the quick brown fox and the other one that was with them", "de": "der schnelle braune Fuchs und das andere nicht mit dem ein"}
    r = random.Random(1)
    rows = [(i, " ".join(r.sample(sample[k].split(), 6)), k, "s", 1) for i in range(120) for k in [("en", "de")[i % 2]]]
    rows += [(120, None, "en", "s", 1), (121, "", "en", "s", 1), (122, "123 --", "de", "s", 1), (123, "the fox", None, None, None), (123, "the fox", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = language_id.query(spark, write(spark, tmp_path, documents=df)).toPandas()
    by = out.set_index("doc_id")
    assert len(out) == len(rows) and out["score"].between(0, 1).all()
    assert list(by.loc[[120, 121, 122], "lang_pred"]) == ["und"] * 3
    assert all(by.loc[i, "lang_pred"] == ("en", "de")[i % 2] for i in range(120)) and (by.loc[123, "lang_pred"] == "en").all()
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(out["doc_id"], out["held_out"], strict=True))
    kept = language_id.known(df)
    assert kept.columns == df.columns and kept.count() == 122
    assert language_id.query(spark, write(spark, tmp_path / "empty", documents=df.where("doc_id < 0"))).count() == 0


def test_pipeline(spark, tmp_path, corpus):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    items = [(1, " ".join(corpus[3].split()[10:30]))]
    path = write(spark, tmp_path, documents=docs_frame(spark, corpus), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, path).collect()}
    texts = {i: t for i, t in enumerate(corpus) if t and any(c.isalpha() for c in t)}
    keys = list(texts)
    first = brute_classes([texts[k] for k in keys])
    texts = {keys[c]: texts[keys[c]] for c in sorted(set(first))}
    keys, cut = list(texts), {}
    data = [texts[k].encode() for k in keys]
    seen = collections.Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    for k, d in zip(keys, data, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if seen[d[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        cut[k] = bytes(x for x, f in zip(d, gone, strict=True) if not f).decode("utf-8", "ignore")
    clean = {k: t for (k, t), w in zip(cut.items(), brute_decontaminate(list(cut.values()), items, 10), strict=True) if not w[4]}
    assert set(out) == set(clean) and 3 not in out
    from scorelake.llm.pieces import Pieces

    codec = sentencepiece_codec.Codec(Pieces.load(token_counts.MODEL))
    assert all(list(out[k]) == codec.encode(t) for k, t in clean.items())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    from conftest import rows

    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
