"""Golden values of the plain algorithms, and their use over columns."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import algorithms as A


def test_strings():
    assert A.damerau_levenshtein("ca", "abc") == 2 and A.damerau_levenshtein("ab", "ba") == 1
    assert A.damerau_similarity("", "") == 1 and A.near_match("Kitten", "kitten") == 1
    assert A.common_subsequence("abcde", "ace") == 3 and A.best_option("the red car", ["blue", "red car", "red cat"]) == 1
    assert A.partial_ratio("cat", "a cot here") == pytest.approx(2 / 3) and A.partial_ratio("", "x") == 1
    t = "the cat sat on the mat".split()
    assert A.bleu(t, t) == pytest.approx(1) and A.gleu(t, t) == 1 and A.rouge_l(t, t) == pytest.approx(1)
    assert A.bleu([], t) == 0 and 0 < A.gleu(t[:3], t) < 1


def test_structures():
    assert A.string_list("['a', 1]") == ["a", "1"] and A.string_list("x") == ["x"] and A.string_list("__import__('os')") == ["__import__('os')"]
    assert A.json_objects('a {"k": [1]} b {bad} {"z": {}}') == ['{"k": [1]}', '{"z": {}}']
    assert A.outer_json('x {"a": "}"} y') == '{"a": "}"}' and A.outer_json("{") is None
    assert A.boxed(r"\boxed{a{b{c{d}}}}") == "a{b{c{d}}}" and A.boxed("x") is None
    assert A.nfkc("ﬁ​１") == "fi1"
    assert A.html_tables("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [[["a", "b"], ["a", "c"]]]
    assert A.markdown_tables("|a|b|\n|-|-|\n|1|2|") == [[["a", "b"], ["1", "2"]]]
    assert A.nested_f1('{"a": 1, "b": [1, 2]}', '{"a": 1, "b": [2, 3]}') == pytest.approx(2 / 3, abs=1e-5)


def test_trees():
    leaf = lambda x, *k: (x, list(k))
    a = leaf("f", leaf("d", leaf("a"), leaf("c", leaf("b"))), leaf("e"))
    b = leaf("f", leaf("c", leaf("d", leaf("a"), leaf("b"))), leaf("e"))
    assert A.tree_distance(a, b) == 2 and A.tree_distance(a, a) == 0
    t = "<table><tr><td>a</td><td>b</td></tr></table>"
    assert A.teds(t, t) == 1 and 0 < A.teds(t, t.replace("b", "x")) < 1


def test_puzzles():
    g = [[1, 2, 3, 4], [3, 4, 1, 2], [2, 1, 4, 3], [4, 3, 2, 1]]
    zero = [[0] * 4] * 4
    assert A.sudoku_right(g, zero) and not A.sudoku_right(g[::-1], [[1, 0, 0, 0], *zero[1:]]) and A.no_repeats(g)
    assert A.nonogram_right([[1, 0, 1], [1, 1, 1]], [[1, 1], [3]], [[2], [1], [2]])
    assert A.hanoi_right([(0, 1), (0, 2), (1, 2)], 2) and not A.hanoi_right([(0, 2), (0, 2)], 2)
    assert A.maze_right("RRD", ["S..", "#.E"]) and not A.maze_right("D", ["S..", "#.E"])
    assert A.queens_right([1, 3, 0, 2]) and not A.queens_right([0, 1, 2, 3])
    e = [(1, 2), (2, 3), (3, 1)]
    assert A.hamiltonian_path([1, 2, 3], e) and A.hamiltonian_path([1, 2, 3], e, True) and A.eulerian_path([1, 2, 3, 1], e) and A.path_right([1, 2], e, [1, 2])
    assert A.points_24("(8 - 4) * (7 - 1)", [8, 4, 7, 1]) and not A.points_24("24", [8, 4, 7, 1]) and not A.points_24("__import__('os')", [])


def test_document_rules():
    assert A.present("some lomg text", "long", 1) and not A.present("some text", "long", 0)
    assert A.in_order("a then b", "a", "b") and not A.in_order("b a", "a", "b")
    assert A.baseline("fine text.") and not A.baseline("x" * 40) and not A.baseline("漢字") and not A.baseline("...")


def test_over_columns(spark):
    df = spark.createDataFrame([("ab", "ba", '{"a": 1}'), (None, "x", "{")], "a string, b string, j string")
    out = df.select(A.vectorised(A.damerau_levenshtein, "int")("a", "b").alias("d"), A.vectorised(A.string_list, "array<string>")("j").alias("l"), A.vectorised(A.nested_f1, "double")("j", F.lit('{"a": 1}')).alias("f")).collect()
    assert [r["d"] for r in out] == [1, None] and out[1]["f"] is None and out[0]["f"] == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize(("said", "want"), [("(A) or (C)", "C"), ("B. is it", "B"), ("so A or B", "B"), ("it has to be the red house I think", "A"), ("red house", None), ("none of all these is right here", None), ("C.", "C"), ("(B)!", "B"), ("A, B and C", "C"), ("blue car and red house stand over there", "A")])
def test_choice_of(said, want):
    assert A.choice_of(said, ["A", "B", "C"], ["red house", "blue car", "green tree"]) == want


@pytest.mark.parametrize(("target", "pred", "kind", "want"), [("3", "3.7", "Int", 1.0), ("3", "x", "Int", 0.0), ("5%", "0.05", "Float", 1.0), ("100", "100.9", "Float", 1.0), ("100", "102", "Float", 0.0), ("$12 (net)", "12", "Str", 1.0), ("page 3", "page 4", "Str", 0.0), ("apple", "apple", "Str", 1.0), ("apple", "apply", "Str", 0.8), ("apple", "plum", "Str", 0.0), ("['2', '1']", "['1', '2']", "List", 1.0), ("['a', 'b']", "['a']", "List", 0.0), ("['abcd', 'x']", "['abcx', 'x']", "List", 0.75)])
def test_typed_score(target, pred, kind, want):
    assert A.typed_score(target, pred, kind) == pytest.approx(want)
