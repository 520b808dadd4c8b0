"""Golden values of the column functions."""

import pytest
from pyspark.sql import Row, functions as F

from scorelake.functions import geometry as G, similarity as S, text as T


def value(spark, column, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else (F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")))
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "want"), [("Yes, it is.", "Yes"), ("no", "No"), ("yes and no", "Unknown"), ("", "Unknown"), ("Yesterday", "Unknown"), ("yes: it is", "Unknown"), ("yes, it is", "Yes"), ("is it? no!", "No"), ("yes/no", "Unknown"), ("it's no. 5", "No")])
def test_yes_or_no(spark, text, want):
    assert value(spark, T.yes_or_no(F.col("a")), a=text) == want


@pytest.mark.parametrize(("text", "want"), [("The answer is (B).", "B"), ("A and B", None), (T.FAILURE, None), ("A. because of many long words here", None), ("Sorry, I can't see it", None), ("", None), ("I cannot see it all but B", "B"), ("Cannot determine the answer", "Z"), ("I'm sorry, but without the image provided B", "Z"), ("Failed to obtain answer via API. B", None), ("Z", "Z"), ("I can't help, so B", "B")])
def test_option_label(spark, text, want):
    assert value(spark, T.option_label(F.col("a"), ["A", "B"]), a=text) == want


def test_option_text(spark):
    options = F.create_map(F.lit("A"), F.lit("red"), F.lit("B"), F.lit("blue"))
    assert value(spark, T.option_text(F.col("a"), options), a="it is really red") is None  # too long for the options
    assert value(spark, T.option_text(F.col("a"), options), a="it is red") == "A"
    assert value(spark, T.infer_option(F.col("a"), options, ["A", "B"]), a="(B)") == "B"


def test_normalize(spark):
    assert value(spark, T.normalize_answer(F.col("a")), a="The two cats, a dog!") == "2 cats dog"
    assert value(spark, T.normalize_answer(F.col("a")), a="dont") == "don't"


@pytest.mark.parametrize(("text", "want"), [("they wed and she shed", "they wed and she shed"), ("lets id im", "lets id im"), ("youdve couldve itd've", "youdve could've it'd've"), ("Im Ive", "im ive"), ("one of the ten", "1 of 10"), ("a,b 1,2", "ab 12"), ("a-b", "b"), ("a- b", "b"), ("x-y z- w", "xy z w"), ("no.5 5.x y.", "no.5 5.x y"), (". " * 40, ". . . . . . . .")])
def test_normalize_golden(spark, text, want):
    assert value(spark, T.normalize_answer(F.col("a")), a=text) == want


@pytest.mark.parametrize(("text", "want"), [("(b)", "B"), ("b", "B"), ("", "A"), ("The answer is C", "C"), ("The best option isThe correct option is D", "D"), ("x y z", ""), ("one two three four five six seven eight nine ten eleven", ""), ("  (e) ", "E"), ("The best option is q", "")])
def test_first_letter(spark, text, want):
    assert value(spark, T.first_letter(F.col("a")), a=text) == want


@pytest.mark.parametrize(("pred", "target", "want"), [(50.0, 100.0, 0.0), (-90.0, -100.0, 1.2), (5.0, 0.0, 0.0), (100.0, 100.0, 1.0)])
def test_mean_relative_accuracy_golden(spark, pred, target, want):
    assert value(spark, S.mean_relative_accuracy(F.col("p"), F.col("t")), p=pred, t=target) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [("a", [1, 0, 0]), ("abab", [1, 2, 1]), ("", [0, 0, 0]), ("x\n\n \ty\n y", [1, 2, 1]), ("aaaa", [4, 2, 1]), ("z" + "ab" * 5000, [1, 5000, 1])])
def test_tail_repeats(spark, text, want):
    from scorelake.functions import algorithms
    from scorelake.operators import ordered

    assert value(spark, ordered.tail_repeats(F.col("a"), 3), a=text) == want == algorithms.tail_repeats(text, 3)


def test_plain_numbers_and_deep_braces(spark):
    assert [value(spark, T.number(F.col("a")), a=x) for x in ("1d", "1e3", " 2.5 ", "1_000", "x", ".5")] == [None, 1000.0, 2.5, 1000.0, None, 0.5]
    assert value(spark, S.relaxed(F.col("p"), F.col("t")), p="1d", t="1") is False
    assert value(spark, T.boxed(F.col("a")), a=r"\boxed{1} \boxed{{a{b{c{d}}}}}") == "{a{b{c{d}}}}"
    assert value(spark, T.boxed(F.col("a")), a=r"\boxed{1") is None and value(spark, T.boxed(F.col("a")), a="x") is None


def test_extraction(spark):
    assert value(spark, T.boxed(F.col("a")), a=r"so \boxed{1} and \boxed{\frac{1}{2}}") == r"\frac{1}{2}"
    assert value(spark, T.last_number(F.col("a")), a="1,234 then 5.5") == 5.5
    assert value(spark, T.number_words(F.col("a")), a="two thousand three hundred and forty-two") == 2342
    assert value(spark, T.clock_seconds(F.col("a")), a="01:02:03.5") == 3723.5
    assert value(spark, T.pairwise_verdict(F.col("a")), a="I say [[A>>B]] and [[A>>B]]") == "A>>B"
    assert value(spark, T.fenced(F.col("a")), a='x ```json\n{"k": 1}\n``` y') == '{"k": 1}'
    assert value(spark, T.thinking(F.col("a")), a="<think>hm</think> ok") == Row(thinking="hm", answer="ok")
    assert value(spark, T.half_width(F.col("a")), a="Ａ１　") == "A1 "
    assert value(spark, T.clean_text(F.col("a"), ["bad"]), a="this is b4aad") is False
    assert value(spark, T.clean_text(F.col("a"), ["bad"]), a="this is badge") is True
    assert value(spark, T.markdown_plain(F.col("a")), a="**a**<br>_b_") == "a b"


def test_edit(spark):
    assert value(spark, S.anls_distance(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(3 / 7)
    assert value(spark, S.anls_similarity(F.col("a"), F.col("b")), a="ab", b="xy") == 0.0


@pytest.mark.parametrize(("pred", "target", "want"), [("105", "100", True), ("106", "100", False), ("5%", "0.05", True), ("Cat", "cat", True), ("0", "0", True)])
def test_relaxed(spark, pred, target, want):
    assert value(spark, S.relaxed(F.col("p"), F.col("t")), p=pred, t=target) is want


def test_leave_one_out(spark):
    assert value(spark, S.leave_one_out(F.col("p"), F.col("t")), p="cat", t=["cat"]) == [0.0]
    assert value(spark, S.leave_one_out(F.col("p"), F.col("t")), p="cat", t=["cat"] * 4) == [1.0] * 4


def test_numbers(spark):
    assert value(spark, S.mean_relative_accuracy(F.col("p"), F.col("t")), p=5.0, t=5.0) == 1.0
    assert value(spark, S.mean_relative_accuracy(F.col("p"), F.col("t")), p=132.0, t=100.0) == pytest.approx(0.4)
    assert value(spark, S.float_equal(F.col("p"), F.col("t")), p=50.0, t=0.5) is True
    assert value(spark, S.relative_difference(F.col("p"), F.col("t")), p=150.0, t=100.0) == 0.5
    assert value(spark, S.angle_rmse(F.col("p"), F.col("t")), p=359.0, t=1.0) == pytest.approx(0.8)
    assert value(spark, S.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) == pytest.approx(10007.5, abs=1)


def test_sets_and_sequences(spark):
    p, t = F.col("p"), F.col("t")
    assert value(spark, S.jaccard(p, t), p=[], t=[]) == 1.0
    assert value(spark, S.jaccard(p, t), p=["a", "b"], t=["b", "c"]) == pytest.approx(1 / 3)
    assert value(spark, S.prefix_ratio(p, t), p=["a", "b", "x"], t=["a", "b", "c", "d"]) == 0.5
    assert value(spark, S.prefix_ratio(p, t), p=["a"], t=["a", "b"]) == 0.5
    assert value(spark, S.sequence_accuracy(p, t), p=["a", "x"], t=["a", "b"]) == 0.5
    assert value(spark, S.multiset_overlap(p, t), p=["a", "a", "b"], t=["a", "b", "b"]) == 2
    assert value(spark, S.bag_f1(p, t), p=["a", "b"], t=["a"]) == pytest.approx(2 / 3)
    m = lambda **kw: F.create_map(*[F.lit(x) for e in kw.items() for x in e])
    assert value(spark, S.dict_recall(m(a=1, b=2), m(a=1, b=3))) == 0.5
    assert value(spark, S.dict_equality(m(a=1, b=2), m(b=2, a=1))) == 1.0


def test_boxes(spark):
    b = lambda *v: G.box(*map(F.lit, v))
    assert value(spark, G.iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert value(spark, G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0.0
    assert value(spark, G.center_inside(b(0, 0, 2, 2), b(1, 1, 3, 3))) is True
    assert value(spark, G.point_distance(F.lit(5.0), F.lit(1.0), b(0, 0, 2, 2))) == 3.0
    assert value(spark, G.parse_box(F.col("a"), F.lit(100), F.lit(200)), a="[0.5, 0.1, 0.1, 0.9]") == Row(x1=10.0, y1=20.0, x2=50.0, y2=180.0)


def test_intervals(spark):
    iv = lambda *v: F.array(*[F.struct(F.lit(float(s)).alias("start"), F.lit(float(e)).alias("end")) for s, e in v])
    assert [tuple(x) for x in value(spark, G.merge_intervals(iv((1, 3), (2, 5), (7, 8))))] == [(1, 5), (7, 8)]
    assert value(spark, G.interval_sets_iou(iv((1, 3), (2, 5), (7, 8)), iv((4, 8)))) == pytest.approx(2 / 7)
    assert value(spark, G.time_iou(*map(F.lit, (0.0, 10.0, 5.0, 15.0)))) == pytest.approx(1 / 3)


def many(spark, column, cases):
    """The column's values over cases, rows of (a, b)."""
    rows = [(k, *c) for k, c in enumerate(cases)]
    kind = lambda v: "double" if isinstance(v, float) else "array<string>" if isinstance(v, list) else "string"
    shape = f"k int, a {kind(next((c[0] for c in cases if c[0] is not None), ''))}, b {kind(next((c[1] for c in cases if c[1] is not None), ''))}"
    return [x[0] for x in spark.createDataFrame(rows, shape).orderBy("k").select(column).collect()]


def test_white_space_of_any_kind(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = ["".join(spaces) + "x" + "".join(spaces), *(f"{s}a{s}{s}b {s}" for s in spaces), "​z​", "", "\n\n"]
    assert many(spark, T.strip(F.col("a")), [(x, None) for x in texts]) == [x.strip() for x in texts]
    assert many(spark, T.words(F.col("a")), [(x, None) for x in texts]) == [x.split() for x in texts]
    for s in ("\n", "\t", " ", "　"):
        assert value(spark, T.yes_or_no(F.col("a")), a=f"yes{s}it is") == "Yes"
        assert value(spark, T.option_label(F.col("a"), ["A", "B"]), a=f"答案{s}B") == "B"
        assert value(spark, T.normalize_answer(F.col("a")), a=f"{s}the{s}two{s}") == "2"
        assert value(spark, T.thinking(F.col("a")), a=f"<think>{s}so{s}</think>{s}{s}B{s}") == Row(thinking="so", answer="B")


def test_thinking_as_it_stands(spark):
    cases = {
        "no marks ": ("", "no marks "),
        "x</think> A": ("x</think>", "A"),
        "<think>a</think>b</think>\nC": ("<think>a</think>b</think>", "C"),
        "pre<think> t </think>": ("t", ""),
    }
    for text, want in cases.items():
        assert tuple(value(spark, T.thinking(F.col("a")), a=text)) == want
    assert tuple(many(spark, T.thinking(F.col("a")), [(None, None)])[0]) == (None, None)


def test_prefixes_and_percents_are_not_stripped(spark):
    assert many(spark, T.yes_or_no_prefix(F.col("a")), [(" Yes", None), ("Yes.", None), ("\nno", None), ("Not", None)]) == [None, "yes", None, "no"]
    assert many(spark, S.relaxed(F.col("a"), F.col("b")), [("5% ", "0.05"), ("5%", "0.05"), (" 5 ", "5.1"), ("a ", "a"), ("3", "0"), ("0", "0")]) == [False, True, True, False, False, True]


def test_strings_as_they_stand(spark):
    cases = [("(A) foo", "A"), ("A . x", "A"), ("Apple", "A"), ("a.", "A"), (" A", "A"), ("A", "A"), (" cat", "cat"), ("cat", "cat"), ("7", "7"), ("75", "7"), ("é!", "é"), ("(b) x", "B"), (None, "A")]
    assert many(spark, S.exact(F.col("a"), F.col("b")), cases) == [1, 1, 1, 0, 0, 1, 0, 1, 1, 0, 0, 0, None]
    assert many(spark, S.exact_any_case(F.col("a"), F.col("b")), [("(b) x", "B"), ("CAT", "cat"), ("cat ", "cat")]) == [1, 1, 0]
    assert many(spark, S.simple_match(F.col("a"), F.col("b")), [("U.S.", "us"), ("a-b\n c\t", "ABC"), ("a b", "ab"), ("B) yes", "b")]) == [1, 1, 0, 1]
    assert many(spark, S.multi_reference(F.col("a"), F.col("b")), [("U.S.", ["usa", "us"]), ("x", ["y"]), ("x", [])]) == [1, 0, 0]
    assert many(spark, S.rating(F.col("a")), [("\nCorrect", None), ("It is Correct", None), ("Incorrect, not Correct", None), ("Correct, not Incorrect", None), ("not Incorrect, Correct", None), ("correct", None), ("", None), (None, None)]) == [1, 1, 0, 1, 0, 0, 0, None]
    assert many(spark, S.short_or_anls(F.col("a"), F.col("b")), [("cat", "cat\n"), ("a\nCAT", "cat"), ("kitten", "sitten"), ("xyz", "cat"), ("a b c d e", "a b c d e"), ("", "")]) == [1, 1, pytest.approx(5 / 6), 0, 0, 1]
    assert many(spark, S.short_or_anls_any(F.col("a"), F.col("b")), [("a b c d f", ["a b c d e"]), ("kitten", ["sitten"]), ("one two", ["x", "TWO "]), ("x", [])]) == [pytest.approx(8 / 9), 0, 1, 0]
    assert many(spark, T.whole_word(F.col("a"), F.col("b")), [("a cat.", "cat"), ("concat", "cat"), ("c++ x", "c+"), ("naïve é", "é"), ("ab", None)]) == [True, False, False, True, None]


def test_whole_numbers_and_estimates(spark):
    cases = [("3", "3"), ("3", "4"), ("0", "0"), ("-2", "0"), ("0", "3"), ("x", "3"), ("3.0", "3"), ("007", "7"), (" 1_000 ", "1000"), ("3", ""), ("00", "-1")]
    assert many(spark, S.positive_int_match(F.col("a"), F.col("b")), cases) == [1, 0, -1, -1, 0, 0, 0, 0, 1, 0, -1]
    got = many(spark, S.estimation_score(F.col("a"), F.col("b")), [(-90.0, -100.0), (100.0, 100.0), (150.0, 100.0), (1.0, 0.0), (None, 1.0)])
    assert got == [pytest.approx(0.8), 1.0, 0.0, 0.0, 0.0]


def test_bag_f1_of_long_lists(spark):
    """Lists that are expressions are worked out once, not once a word."""
    import time

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda x: (x % 5).cast("string")))
    df = spark.range(1).select(F.concat(text, F.lit(" a"), F.col("id").cast("string")).alias("p"), F.concat(text, F.col("id").cast("string")).alias("t"))
    began = time.perf_counter()
    got = df.select(S.bag_f1(F.split("p", " "), F.split("t", " ")).alias("f1")).first()["f1"]
    assert got == pytest.approx(2 * (8000 / 8001) * (7999 / 8000) / (8000 / 8001 + 7999 / 8000)) and time.perf_counter() - began < 8
