"""Operators 11 to 13 against brute force on small tables, with odd inputs, and with the limits that split hot groups set low."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import registry, spelling_variants, super_kmer, token_alignment

CLASH = "node string, at int, first int, key string, n int, hot boolean, spans int, word string, n_a string, partial boolean"


def docs_frame(spark, rows, kind="long"):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")])


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeiounrst") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(45)
    out = [text(r.randint(20, 90)) for _ in range(8)]
    out += [f"{text(r.randint(0, 40))}\n {shared}\t{text(r.randint(0, 40))}" for _ in range(9)]
    out += [out[0], out[0], out[9], None, "", "   ", " \n", "one two", "one two", text(19), "ab " * 400, "ab cd " * 60, " é　 x\x0by\x1cz " * 30, f"{out[1]} {out[1]}"]
    return list(enumerate(out))


def order(row):
    return row[0] is None, row[0] or 0, hashlib.md5((row[1] or "").encode()).digest()


def brute_windows(rows, size):
    """n_words, n_removed, kept of every row; repeated rows are one document."""
    seen, out = set(), {}
    for row in sorted(set(rows), key=order):
        w = (row[1] or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            window = tuple(w[p : p + size])
            if window in seen:
                gone[p : p + size] = [True] * size
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[row] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return [out[row] for row in rows]


@pytest.mark.parametrize(("window", "gram", "hot"), [(20, 5, 4096), (20, 5, 2), (6, 3, 3), (3, 5, 1)])
def test_super_kmer(spark, corpus, monkeypatch, window, gram, hot):
    monkeypatch.setattr(super_kmer, "HOT", hot)
    monkeypatch.setattr(super_kmer, "LONGEST", 7)
    got = {r[0]: tuple(r)[1:] for r in super_kmer.digest(docs_frame(spark, corpus), window, gram).collect()}
    assert [got[i] for i, _ in corpus] == brute_windows(corpus, window)
    assert super_kmer.digest(docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_super_kmer_goes_by_row(spark, corpus, monkeypatch, hot):
    """Null and repeated ids: unlike texts under one id are documents each, repeated rows are one, those without id come last."""
    monkeypatch.setattr(super_kmer, "HOT", hot)
    r = random.Random(3)
    texts = [t for _, t in corpus]
    rows = [(r.choice([None, 1, 2, 3, 4]), t) for t in texts for _ in range(2)]
    want = Counter((row[0], *x) for row, x in zip(rows, brute_windows(rows, 20), strict=True))
    assert Counter(map(tuple, super_kmer.digest(docs_frame(spark, rows)).collect())) == want


def test_super_kmer_removal(spark, corpus):
    rows = [(f"d{i:03}", t) for i, t in corpus]
    left = {r["doc_id"]: r["text"] for r in super_kmer.remove(docs_frame(spark, rows, "string")).collect()}
    for (i, t), (n, gone, sha) in zip(rows, brute_windows(rows, 20), strict=True):
        assert left[i] is None if t is None else hashlib.sha256(left[i].encode()).hexdigest() == sha and len(left[i].encode().split()) == n - gone


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    return len(v) - len(u) == 1 and any(u == v[:k] + v[k + 1 :] for k in range(len(v)))


def test_trie_join_finds_all_pairs_at_distance_one():
    r = random.Random(2)
    for letters, n in (("ab", 40), ("abcdeé", 200)):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 7))) for _ in range(n)})
        got = [(words[i], words[j]) for i, j, _ in spelling_variants.near_in_trie(words)]
        assert len(got) == len(set(got))
        assert {frozenset(p) for p in got} == {frozenset(p) for p in combinations(words, 2) if near(*p)}


def brute_variants(rows, least, count, spared, times):
    import re

    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % spared == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    form, out = {}, {}
    for w, k in n.items():
        around = sorted((-n[v], v) for v in n if near(v, w))
        form[w] = around[0][1] if around and -around[0][0] >= times * k else None
        out[w] = (k, len(around), n[form[w]] if form[w] else None)
    for w, (k, m, f) in out.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, k, m, f)
    return out


@pytest.mark.parametrize("most", [4096, 8, 1])
def test_spelling_variants(spark, most):
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeéß") for _ in range(r.randint(4, 9))) for _ in range(12)]
    rows = []
    for i in range(160):
        words = []
        for _ in range(r.randint(0, 40)):
            w = stems[min(int(r.expovariate(0.4)), 11)]
            for _ in range(int(r.random() < 0.3) + int(r.random() < 0.1)):
                k = r.randrange(len(w))
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "É" + w[k + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i if r.random() < 0.9 else None, r.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(7, None), (8, ""), (9, "b" * 5000), rows[0], rows[0], (10, "×÷×÷×÷ " * 9)]
    got = {x[0]: tuple(x)[1:] for x in spelling_variants.variants(docs_frame(spark, rows), 5, 2, 7, 2, most).collect()}
    want = brute_variants(rows, 5, 2, 7, 2)
    assert got == want
    assert sum(v[0] is not None for v in want.values()) > 10
    assert any(v[0] is not None and v[0] != v[1] for v in want.values())
    assert spelling_variants.variants(docs_frame(spark, [])).count() == 0


ODD = [None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\nends", "a▁b", "<s> </s> <|endoftext|> <unk> <0x41>", "é ß 漢字 🙂 ́", "\0 \x7f", "x" * 3000, " " * 500, "ab" * 2000 + " cd", " 　", "naïve café's don't I'LL 12345 3.14"]


def brute_alignment(rows):
    """Every column by plain loops, from the libraries' own encodings."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    letters = token_alignment.byte_letters()
    docs = []
    for _, text in rows:
        one, two = [], []
        if text:
            ids = a.encode(f" {text}", add_special_tokens=False).ids
            one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
            for i in b.encode(text):
                p = b.id_to_piece(i)
                two.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
            whole = f" {text}".encode()
            if b"".join(x for _, x in one) != whole or b"".join(x for _, x in two) != whole:
                one, two = [], []
        groups, at = [[[], []]], [0, 0]
        while one or two:
            side = 0 if at[0] <= at[1] else 1
            i, x = (one, two)[side].pop(0)
            groups[-1][side].append(i)
            at[side] += len(x)
            if at[0] == at[1]:
                groups.append([[], []])
        docs.append(groups[:-1])
    held = Counter(p for groups in docs for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    top = Counter()
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for groups in docs:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        told = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        sha = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha))
    return out


@pytest.mark.parametrize(("block", "piece"), [(1 << 22, 1 << 20), (300, 5000)])
def test_token_alignment(spark, sf_dir, monkeypatch, block, piece):
    monkeypatch.setattr(token_alignment, "PIECE", piece)
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    rows = list(enumerate([*ODD, *texts, texts[0], texts[0]]))
    got = {r[0]: tuple(r)[1:] for r in token_alignment.align(docs_frame(spark, rows), block=block).collect()}
    assert [got[i] for i, _ in rows] == brute_alignment(rows)


def test_token_alignment_without_tokens(spark):
    assert token_alignment.align(docs_frame(spark, [])).count() == 0
    got = sorted(token_alignment.align(docs_frame(spark, [("b", None), (None, ""), ("a", "a▁b")], "string")).collect(), key=str)
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_byte_side_equals_the_library(sf_dir, spark):
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_MODEL)
    a.encode_special_tokens = True
    texts = [t for t in ODD if t] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").where("text is not null").collect()]
    assert token_alignment.ByteSide().encode(texts) == [a.encode(t, add_special_tokens=False).ids for t in texts]
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.PIECE_MODEL)
    assert token_alignment.PieceSide().encode(texts) == [b.encode(t) for t in texts]


@pytest.mark.parametrize("name", ["op11_super_kmer", "op12_spelling_variants"])
def test_queries_equal_their_sql(spark, sf_dir, duck, name):
    from conftest import rows

    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def test_alignment_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES["op13_token_alignment"](spark, sf_dir).collect()}
    assert [got[r[0]] for r in docs] == brute_alignment([tuple(r) for r in docs])
    assert np.array([v[2] for v in got.values()]).sum() > 0
