"""Exactness and held-out accuracy of the models' Python parts, without Spark."""

import itertools
import random

import numpy as np
import pytest

from scorelake.llm import hnsw, html_extract, html_pages, language_id, order_minhash, pieces, ring, suffix_merge, toxicity
from scorelake.llm.html_blocks import blocks
from scorelake.llm.sentencepiece_codec import Codec
from scorelake.llm.token_counts import MODEL, TextCounter

ODD = ["", " ", "  a", "a\nb", "\na", "a \n b", "日本語 テスト", "▁x ▁", "a\tb", "x" * 500, "é" * 30, "the  the   the", "\n\n\n", "a ", " a", "\0", "😀 ok"]


@pytest.fixture(scope="module")
def vocabulary():
    import os

    if not os.path.exists(MODEL):
        pytest.skip("no vocabulary file")
    return pieces.Pieces.load(MODEL)


@pytest.fixture(scope="module")
def library():
    """The library's own unigram model over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for rank, p in enumerate(p for p in m.pieces if p.type == 1):
        p.score = -float(rank)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def texts():
    r = random.Random(3)
    return ODD + ["".join(r.choice("the ining.,\n éß▁x1 ") for _ in range(r.randint(1, 120))) for _ in range(300)]


def test_codec_and_counts_equal_the_library(vocabulary, library):
    codec, count = Codec(vocabulary), TextCounter(vocabulary)
    for t in texts():
        assert codec.encode(t) == library.encode(t), t
        assert count(t) == len(codec.encode(t))
        if "▁" not in t:
            assert codec.decode(codec.encode(t)) == t
    assert codec.encode(None) == [] and count(None) == 0


def test_memo_changes_no_id_and_streams_commit(vocabulary):
    plain, quick = Codec(vocabulary, memo=False), Codec(vocabulary)
    for t in texts():
        assert plain.encode(t) == quick.encode(t), t
    assert not plain.marked and not plain.bare and quick.marked
    whole = pieces.Streaming(vocabulary, vocabulary.automaton())
    words_ = "one stream of several words".split()
    ids = [whole.push("\u2581" + w) + whole.settle() for w in words_]
    assert all(ids) and len(whole.score) == 1 and sum(ids, []) == plain.encode(" ".join(words_))


def test_ties_keep_the_longest_last_piece():
    def small(scores):
        p = pieces.Pieces([(k, v, i) for i, (k, v) in enumerate(scores.items())], list(range(100, 356)), [], -50.0)
        stream = pieces.Streaming(p, p.automaton())
        return stream.push("abc") + stream.finish(), pieces.Counter(p).count("abc")

    assert small({"a": -1.0, "bc": -1.0, "ab": -1.0, "c": -1.0}) == ([0, 1], 2)  # last piece bc, not c
    assert small({"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0}) == ([2, 3], 2)


def test_stream_window_is_bounded(vocabulary):
    automaton = vocabulary.automaton()
    t = "nospacesinthistextatall" * 400
    whole, single = pieces.Streaming(vocabulary, automaton), pieces.Streaming(vocabulary, automaton)
    ids = whole.push(t) + whole.finish()
    assert [i for c in t for i in single.push(c)] + single.finish() == ids
    assert whole.held <= 2 * vocabulary.longest + whole.STEP + 1
    assert len(ids) == pieces.Counter(vocabulary).count(t)


def test_memo_is_bounded():
    m = pieces.Memo(len, 3)
    assert [m[w] for w in ("a", "bb", "ccc", "dddd", "a")] == [1, 2, 3, 4, 1] and len(m) <= 3


def test_crf_on_held_out_pages():
    model = html_extract.train(html_pages.labelled(300))
    decode, right, n = model.decoder(), 0, 0
    for html in html_pages.labelled(100, seed=99):
        found = blocks(html)
        gold = [int("" in b.text) for b in found]
        plain = [b._replace(text=b.text.strip("") or "-") for b in found]
        right += sum(a == b for a, b in zip(decode(plain), gold, strict=True))
        n += len(gold)
    assert right / n > 0.97


def test_viterbi_is_the_best_labelling():
    model = html_extract.train(html_pages.labelled(60), rounds=30)
    page = blocks("<nav>Home</nav><article><p>Some text here.</p><div class=ad>Buy</div><p>More</p></article><footer>x</footer>")
    score = lambda b, k: sum(model.weights[f][k] for f in (*html_extract.path_features(b.path), *html_extract.text_features(b)) if f in model.weights)

    def total(ls):
        return model.first[ls[0]] + sum(model.between[a][b] for a, b in itertools.pairwise(ls)) + sum(score(b, k) for b, k in zip(page, ls, strict=True))

    assert total(model.decoder()(page)) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=len(page)))))


@pytest.mark.parametrize(("html", "want"), [(None, []), ("", []), ("plain &amp; text", ["plain & text"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</b>\n c<br>d</p>", ["a b c d"]), ('<script>"</p>"</script><p title=">">x</p>', ["x"]), ("<ul><li>1<li>2</ul>", ["1", "2"]), ("<p>a<!-- <p>no</p> --> b</p>", ["a b"]), ("<p>a &lt;b&gt;&nbsp;&nbsp;c", ["a <b> c"]), ("<p>1 < 2</p>", ["1 < 2"])])
def test_blocks(html, want):
    assert [b.text for b in blocks(html)] == want


def test_hidden_blocks_and_unclosed_raw_elements():
    found = blocks('<div class="a.b > c" hidden>x &am<b>p;</b></div>' + "<option>a" * 20_000 + "<p>q")
    assert found[0].text == "x &amp;" and "hidden=yes" in html_extract.path_features(found[0].path) and "class=c" in html_extract.path_features(found[0].path)
    assert found[-1].text == "q"
    decode = html_extract.train().decoder()
    found = blocks('<article><h1>Head</h1><p>One two three words here.</p><div style="display:none"><p>Secret words in here.</p></div><p hidden>Gone too.</p><p>Last one here.</p></article>')
    assert decode(found) == [1, 1, 0, 0, 1]
    assert decode(blocks("<article><p>Same.</p><p>Same.</p></article>")) == [1, 1]  # repeated blocks stay


def test_counterfactual_penalty_takes_weight_off_identity_terms():
    rows = [("muslim scum", 1.0), ("muslim idiot", 1.0), ("muslim trash", 1.0), ("christian day", 0.0), ("christian sun", 0.0), ("fine words", 0.0), ("calm words", 0.0), ("muslim friends", 0.0)] * 4
    plain, fair = toxicity.fit(rows, swap=0.0), toxicity.fit(rows, swap=5.0)
    gap = lambda m: abs(m.scorer()("muslim people") - m.scorer()("christian people"))
    assert gap(fair) < 0.5 * gap(plain)
    assert 0 <= fair.scorer()(None) <= 1 and toxicity.fit([]).scorer()("x") < 0.5


def test_counterfactual_pairs_exist_whatever_the_corpus_and_spare_neutral_mentions():
    """Toxic texts name one group more often. The penalty must cost no toxic text and spare neutral mentions."""
    r = random.Random(5)
    plain_words = "river stone light green calm paper table window garden whittle womenfolk blackbird".split()
    text = lambda toxic: " ".join(r.choice(plain_words) for _ in range(12)) + (f" {r.choice(('scum', 'idiot', 'trash'))}" if toxic and r.random() < 0.8 else "")
    rows = [(text(k % 4 == 0) + (" muslim" if r.random() < (0.8 if k % 4 == 0 else 0.03) else ""), float(k % 4 == 0)) for k in range(400)]
    free, fair = toxicity.fit(rows, swap=0.0), toxicity.fit(rows, swap=50.0)
    neutral = [f"{text(False)} muslim {w}" for w in ("teacher", "cook", "music", "day") for _ in range(25)]
    wrong = lambda m: sum(m.scorer()(t) >= 0.5 for t in neutral)
    assert fair.pairs > len(rows) and fair.active > 0 and wrong(free) > 50 and wrong(fair) == 0
    assert all(fair.scorer()(f"{text(False)} {w}") > 0.5 for w in ("scum scum", "idiot", "trash"))
    none = toxicity.fit([("calm river", 0.0), ("scum idiot", 1.0)] * 5)
    assert none.pairs >= 10  # no text names a group: terms are put in
    everyone = toxicity.fit([("muslim women", 0.0), ("black gay", 1.0)] * 5)
    assert 0 <= everyone.scorer()("muslim women black gay " * 20_000) <= 1


def test_language_sums_equal_brute_force():
    known, p = ["a", "b", "ab", "ba", "aba"], np.array([[0.3, 0.1], [0.2, 0.2], [0.1, 0.3], [0.2, 0.2], [0.2, 0.2]])
    m = language_id.Unigrams(known, p)

    def brute(w, k):
        if not w:
            return 1.0
        return sum((p[known.index(w[:n]), k] if w[:n] in known else language_id.UNKNOWN if n == 1 else 0) * brute(w[n:], k) for n in range(1, len(w) + 1))

    words = ["a", "ab", "aba", "abab", "bax", "xx", "ababa" * 10]
    got = m.forward(words)
    for w, row in zip(words[:-1], got, strict=False):
        assert np.exp(row) == pytest.approx([brute(w, 0), brute(w, 1)])
    assert np.allclose(m.long("abab"), got[3]) and np.isfinite(got).all()


def test_language_training_tells_languages_apart():
    rows = [("der die das und nicht", "de"), ("the and of that not", "en")] * 5
    names, p = language_id.train(rows, sorted({c for t, _ in rows for c in t.replace(" ", "")} | {"the", "der", "und", "and"}))
    preds, scores = language_id.Judge(names, p, sorted({c for t, _ in rows for c in t.replace(" ", "")} | {"the", "der", "und", "and"}))(["the and", "die und", None, "12 !", ""])
    assert preds == ["en", "de", "und", "und", "und"] and all(0 <= s <= 1 for s in scores)
    assert language_id.Judge([], np.zeros((1, 0)), ["a"])(["abc"]) == (["und"], [0.0])


def test_language_training_learns_from_long_words():
    """Scripts without spaces: a sentence is one word, of more than 40 bytes or characters."""
    r = random.Random(4)
    make = lambda often: "".join(r.choice("天地人山水" + often * 8) for _ in range(r.choice((15, 30, 200))))
    rows = [(make(often), lang) for often, lang in (("日", "a"), ("月", "b"), ("火", "c")) for _ in range(8)]
    known = sorted("天地人山水日月火") + ["日日", "月月", "火火"]
    names, p = language_id.train(rows, known)
    assert language_id.Judge(names, p, known)(["日月日日", "月月火天月", "火天火日火"])[0] == ["a", "b", "c"]
    m, words, counts = language_id.Unigrams(known, p), ["日日日月", "天", "月月月月火火"], np.arange(1.0, 10).reshape(3, 3)
    assert np.allclose(m.expected_long(words, counts), m.expected(words, counts))
    long = ["日" * 39 + "月月", "火" * 3000]
    n = m.expected(long, np.ones((2, 3)))
    assert np.isfinite(n).all() and (n.T @ [len(k) for k in known]) == pytest.approx([3041] * 3)


def test_graph_recall():
    v = np.random.default_rng(5).standard_normal((800, 16))
    g = hnsw.Graph(v)
    hits = [len(set(g.nearest(q, 80)[:20]) & set(np.argsort(-(v @ q))[:20].tolist())) for q in v[::20]]
    assert np.mean(hits) / 20 > 0.9
    assert hnsw.Graph(v[:1]).nearest(v[0], 10) == [0]


def test_merge_of_runs():
    r = random.Random(1)
    for _ in range(200):
        runs = []
        for _ in range(r.randint(1, 7)):
            s = sorted(bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 8))) for _ in range(r.randint(0, 12)))
            coded = suffix_merge.front_code(s)
            assert suffix_merge.decode(*coded) == s
            runs.append((s, coded[0].tolist()))
        order, lcp = suffix_merge.merge(runs)
        got = [runs[a][0][b] for a, b in order]
        assert got == sorted(x for s, _ in runs for x in s)
        assert lcp[1:] == [suffix_merge.common(a, b) for a, b in itertools.pairwise(got)]


def lcs(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(max(p[j + 1], q[j], p[j] + (x == y)))
        p = q
    return p[-1]


@pytest.mark.parametrize("values", [3, 1000])
def test_alignment_equals_brute_force(values):
    r = random.Random(values)
    for _ in range(500):
        a = [r.randint(0, values) for _ in range(r.randint(1, 40))]
        b = list(a)
        for _ in range(r.randint(0, 5)):
            k = r.randint(0, len(b))
            b[k : k + r.randint(0, 1)] = [r.randint(0, values)] * r.randint(0, 1)
        if b:
            n = lcs(a, b)
            want = n / (len(a) + len(b) - n) >= 0.8 - 1e-12
            most = int((len(a) + len(b)) / 9 + 1e-9)
            x, y = np.array(a, np.uint64), np.array(b, np.uint64)
            assert order_minhash.aligned(x, y) == order_minhash._by_diagonals(x, y, most) == want


def test_ring_law_and_limited_movement():
    r = random.Random(2)
    counts = {r.randrange(ring.SLOTS): r.randint(1, 5) for _ in range(3000)} | {7: 4000}  # one hot slot
    runs = ring.runs(counts, 40)
    n = sum(counts.values())
    held = [0] * 40
    for slot, a, b, shard, base in runs:
        assert base == held[shard]
        held[shard] += b - a
    assert sum(held) == n and max(held) - min(held) <= 1
    for slot, k in counts.items():
        assert [x for s, a, b, _, _ in runs if s == slot for x in range(a, b)] == list(range(k)) or sorted(x for s, a, b, _, _ in runs if s == slot for x in range(a, b)) == list(range(k))
    even = {s: 1 for s in range(0, ring.SLOTS, 4)}
    where = lambda m: {s: sh for s, _, _, sh, _ in ring.runs(even, m)}
    a, b = where(40), where(41)
    assert sum(a[s] != b[s] for s in even) < 0.5 * len(even)


@pytest.mark.parametrize("page", ["<div class=abcdefgh>" * 100_000 + "text", "".join(f"<div class='a{chr(97 + k % 26)}'>w{k} " for k in range(100_000)), "<div>" * 50_000 + "</p>" * 50_000 + "x" + "</div>" * 50_000 + "y"])
def test_deep_nesting_takes_little(page):
    import time
    import tracemalloc

    decode = html_extract.train([f"<article><p>\ue000\ue001One two {k}.</p></article><footer>\ue000x</footer>" for k in range(4)], 5).decoder()
    began = time.process_time()
    found = blocks(page)
    labels = decode(found)
    assert time.process_time() - began < 5
    assert len(labels) == len(found) > 0
    del found
    tracemalloc.start()
    decode(blocks(page))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6


def test_scores_above_a_block_equal_their_features():
    r = random.Random(3)
    model = html_extract.train()
    for _ in range(30):
        page = "".join(r.choice(["<div class=nav>", "<article>", "<ul>", "<li>", "</div>", "</ul>", "<p>", "</p>", "<footer id='x ad'>", "</footer>", "text. "]) for _ in range(60))
        above = html_extract._Above(model.weights)
        for b in blocks(page):
            want = [sum(model.weights[f][k] for f in html_extract.path_features(b.path) if f in model.weights) for k in (0, 1)]
            assert above(b.path) == pytest.approx(want)
