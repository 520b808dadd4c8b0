"""Normalising answers and extracting them from free text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Answer normalisation.
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
# Contractions that answer normalisation puts right, quirks and keys that lower case never meets included.
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't",
    "couldn'tve": "couldn't've", "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't",
    "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't",
    "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll",
    "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd",
    "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am", "mightnt": "mightn't",
    "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't",
    "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't",
    "ow's'at": "'ow's'at", "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've",
    "she'dve": "she'd've", "she's": "she's", "shouldve": "should've", "shouldnt": "shouldn't",
    "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd",
    "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've",
    "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd",
    "thered've": "there'd've", "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd",
    "theyd've": "they'd've", "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've",
    "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't",
    "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's",
    "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've",
    "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're",
    "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't", "wouldnt've": "wouldn't've",
    "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd",
    "youd've": "you'd've", "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
# What a failed call and a refusal say.
FAILURE = "Failed to obtain answer via API"
REFUSALS = ["Sorry, I can't help with images of people yet.", "I can't process this file.", "I'm sorry, but without the image provided", "Cannot determine the answer"]
# Lead-ins of an answer letter; two of them are two phrases in one, as in the data they must agree with.
LEAD_INS = ["The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:"]
#: Periods outside numbers that normalisation takes away, at most.
PERIODS = 32
# The characters that Python's str takes as white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A number as Python's float reads it, without white space around it.
NUMBER = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+)?\z"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def single_spaced(c: Column) -> Column:
    """Every run of white space of any kind as one space."""
    return F.regexp_replace(F.translate(c, SPACES[1:], " " * (len(SPACES) - 1)), "  +", " ")


def words(c: Column) -> Column:
    """Non-empty tokens between white space of any kind; null gives null."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda x: x != "")


def drop_punctuation(c: Column) -> Column:
    """Each mark goes if it touches a space anywhere in the input, or the input has a digit-comma-digit; otherwise it becomes a space. The first 32 periods outside numbers go."""
    comma = c.rlike(r"\d,\d")
    out = c
    for p in PUNCTUATION:
        touches = c.contains(p + " ") | c.contains(" " + p) | comma
        out = F.replace(out, F.lit(p), F.when(touches, "").otherwise(" "))
    return F.array_join(F.split(out, r"(?<!\d)\.(?!\d)", PERIODS + 1), "")


def digits_articles(c: Column) -> Column:
    """Lower case; number words as digits; no articles; contractions with their apostrophes."""
    numbers, contractions = _map(NUMBER_WORDS), _map(CONTRACTIONS)
    kept = F.filter(words(F.lower(c)), lambda x: ~x.isin(ARTICLES))
    return F.array_join(F.transform(kept, lambda x: F.coalesce(numbers[x], contractions[x], x)), " ")


def number(c: Column) -> Column:
    """A text's value as a double; null unless it is written as a plain decimal number."""
    plain = strip(c)
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def normalize_answer(c: Column) -> Column:
    plain = strip(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")))
    return digits_articles(drop_punctuation(plain))


def yes_or_no(c: Column) -> Column:
    """'Yes' or 'No' if exactly one of the two words occurs among the words without punctuation, else 'Unknown'."""
    tokens = words(drop_punctuation(F.lower(c)))
    yes, no = F.array_contains(tokens, "yes"), F.array_contains(tokens, "no")
    return F.when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def yes_or_no_prefix(c: Column) -> Column:
    """Whether a text begins so; white space before it is no beginning."""
    low = F.lower(c)
    return F.when(low.startswith("yes"), "yes").when(low.startswith("no"), "no")


def option_label(answer: Column, labels: list[str]) -> Column:
    """The one label that stands alone among the last four tokens; 'Z' for refusals, or if only Z stands there; null if
    unclear, or if the call failed."""
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | answer.contains(phrase)
    tokens = words(F.translate(answer, ".()[],:;!*#{}", " " * 13))
    found = F.array_distinct(F.filter(tokens, lambda x: x.isin(labels)))
    label = F.element_at(found, 1)
    at = F.array_position(tokens, label)
    last = (F.size(found) == 1) & (at > F.size(tokens) - 4)
    none = (F.size(found) == 0) & F.array_contains(tokens, "Z")
    return F.when(answer.contains(FAILURE), None).when(refused, "Z").when(last, label).when(none, "Z")


def option_text(answer: Column, options: Column) -> Column:
    """The one option (map label -> text) that the answer contains; null if the answer is over twice as long as all options, or none or several are contained."""
    low = F.lower(answer)
    size = F.aggregate(F.map_values(options), F.lit(0), lambda acc, v: acc + F.length(v))
    hits = F.map_filter(options, lambda k, v: low.contains(F.lower(v)))
    return F.when((F.length(answer) <= size * 2) & (F.size(hits) == 1), F.element_at(F.map_keys(hits), 1))


def infer_option(answer: Column, options: Column, labels: list[str]) -> Column:
    return F.coalesce(option_label(answer, labels), option_text(answer, options))


def first_letter(c: Column, letters: str = "ABCDE") -> Column:
    """First option letter, after the usual lead-ins are taken away; else the first choice "(A)", "(B)"... that holds the
    text, whatever its case (an empty text is in the first); else ''."""
    c = strip(c)
    for lead in LEAD_INS:
        c = F.replace(c, F.lit(lead), F.lit(""))
    within = F.filter(F.array(*map(F.lit, letters)), lambda x: F.concat(F.lit("("), F.lower(x), F.lit(")")).contains(F.lower(c)))
    return F.when(c.rlike(f"[{letters}]"), F.regexp_extract(c, f"[{letters}]", 0)).when(F.size(words(c)) > 10, "").otherwise(F.coalesce(F.get(within, 0), F.lit("")))


def options_map(df_columns: list[str]) -> Column:
    """label -> text of the option columns that are not null."""
    labels = [c for c in df_columns if len(c) == 1 and c.isupper()]
    whole = F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*[F.col(c).cast("string") for c in labels]))
    return F.map_filter(whole, lambda k, v: v.isNotNull())


def thinking(c: Column, close: str = "</think>") -> Column:
    """struct(thinking, answer) of a text with a reasoning part: what stands between its marks, and what comes after the last
    end mark, both stripped. With several end marks, or none to begin with, all before the last one is the thinking,
    as it stands. A text without end mark is all answer, as it stands."""
    parts = F.split(c, close)
    n = F.size(parts)
    inner = F.get(F.split(parts[0], "<think>"), F.lit(1))
    before = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), close), F.lit(close))
    thought = F.when(n < 2, "").when((n == 2) & inner.isNotNull(), strip(inner)).otherwise(before)
    return F.struct(F.when(c.isNotNull(), thought).alias("thinking"), F.when(n < 2, c).otherwise(strip(F.element_at(parts, -1))).alias("answer"))


def fenced(c: Column, language: str = "json") -> Column:
    """What a fenced code block of a language holds, else the text itself."""
    inner = F.regexp_extract(c, rf"(?s)```{language}\s*(.*?)\s*```", 1)
    return F.when(inner != "", strip(inner)).otherwise(c)


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(c, r"(?m)^```[a-zA-Z]*\s*$\n?", "")


def repeated_chars(c: Column, most: int = 4) -> Column:
    """Runs of one character longer than ``most`` cut to ``most``."""
    return F.regexp_replace(c, rf"(?s)(.)\1{{{most},}}", "$1" * most)


def half_width(c: Column) -> Column:
    """Full-width ASCII as ASCII, the ideographic space as a space."""
    wide = "".join(chr(0xFF01 + k) for k in range(94)) + "\u3000"
    return F.translate(c, wide, "".join(chr(0x21 + k) for k in range(94)) + " ")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def markdown_plain(c: Column) -> Column:
    """Line breaks, bold and italic marks, typographic quotes and runs of white space made plain."""
    c = F.regexp_replace(c, r"<br\s*/?>", " ")
    for pattern in (r"\*\*(.*?)\*\*", r"__(.*?)__", r"\*(.*?)\*", r"_(.*?)_"):
        c = F.regexp_replace(c, pattern, "$1")
    c = F.translate(c, "\u2018\u2019\u201a\u201c\u201d\u201e\u2013\u2014\u2015\uff0d", "'''\"\"\"----")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ocr_tokens(c: Column, by_word: bool = True, alnum: bool = False) -> Column:
    """Lower-case words, or characters, optionally only of letters and digits."""
    c = F.regexp_replace(F.lower(c), r"\s+", " ")
    tokens = F.split(F.trim(c), " ") if by_word else F.split(F.replace(c, F.lit(" "), F.lit("")), "")
    if alnum:
        tokens = F.transform(tokens, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))
    return F.filter(tokens, lambda x: x != "")


def whole_word(c: Column, word: Column) -> Column:
    """Does the word occur in the text between word boundaries?"""
    return F.regexp_like(c, F.concat(F.lit(r"(?U)\b"), F.regexp_replace(word, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit(r"\b")))


def pairwise_verdict(c: Column) -> Column:
    """The one distinct verdict of the form [[A>B]]; null if there is none or they differ."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[\[([AB<>=]+)\]\]"), 1))
    return F.when(F.size(found) == 1, found[0])


def paragraphs(c: Column) -> Column:
    lines = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), "\n")
    return F.filter(F.split(lines, r"\n\n+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.regexp_replace(c, r"(?U)[^\w\s.-]", "")))


def sentence_count(c: Column) -> Column:
    """Runs of end marks that white space or the end follows; text without any is one sentence."""
    return F.when(F.trim(c) == "", 0).otherwise(F.greatest(F.size(F.regexp_extract_all(F.trim(c), F.lit(r"[.!?]+(?=\s|$)"), 0)), F.lit(1)))


def clock_seconds(c: Column) -> Column:
    """Seconds of 'SS', 'MM:SS' or 'HH:MM:SS(.mmm)'."""
    parts = F.transform(F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)




def leet_plain(c: Column) -> Column:
    """Lower case, look-alike digits and signs as letters, marks between letters and runs over three gone."""
    c = F.translate(F.lower(c), "4@31!05$7", "aaeiiosst")
    c = F.regexp_replace(c, r"(?<=[a-z])[\W_]+(?=[a-z]\b)", "")
    return F.regexp_replace(c, r"([a-z])\1{3,}", "$1$1$1")


def clean_text(c: Column, blocked: list[str]) -> Column:
    """No blocked word occurs, also in look-alike spelling with up to three repeats of a letter."""
    pattern = "|".join(r"\b" + "".join(f"{ch}{{1,3}}" for ch in w) + r"\b" for w in blocked)
    return ~leet_plain(c).rlike(pattern)


def number_words(c: Column) -> Column:
    """Value of an English number in words: units and tens add, 'hundred' and 'thousand' multiply. Null if a word is no number."""
    units = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    value = F.create_map(*[F.lit(x) for k, w in enumerate(units) for x in (w, k)], *[F.lit(x) for k, w in enumerate(tens) for x in (w, 20 + 10 * k)])
    tokens = F.filter(words(F.replace(F.lower(c), F.lit("-"), F.lit(" "))), lambda x: x != "and")
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("part"))
    step = lambda a, x: (
        F.when(x == "hundred", F.struct(a["sum"].alias("sum"), (F.greatest(a["part"], F.lit(1)) * 100).alias("part")))
        .when(x == "thousand", F.struct((a["sum"] + F.greatest(a["part"], F.lit(1)) * 1000).alias("sum"), F.lit(0).alias("part")))
        .otherwise(F.struct(a["sum"].alias("sum"), (a["part"] + value[x]).alias("part")))
    )
    return F.aggregate(tokens, start, step, lambda a: a["sum"] + a["part"])


def boxed(c: Column) -> Column:
    """Content of the last \\boxed{...}, braces nested to any depth; null if there is none or it does not end."""
    rest = F.substring_index(c, "\\boxed{", -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    step = lambda a, x: F.when(a["end"] > 0, a).otherwise(
        F.struct(
            (a["depth"] + (x == "{").cast("int") - (x == "}").cast("int")).alias("depth"),
            (a["at"] + 1).alias("at"),
            F.when((x == "}") & (a["depth"] == 1), a["at"] + 1).otherwise(0).alias("end"),
        )
    )
    end = F.aggregate(F.split(rest, ""), start, step)["end"]
    return F.when(c.contains("\\boxed{") & (end > 0), F.substr(rest, F.lit(1), end - 1))


def last_number(c: Column) -> Column:
    """The last number of a text, without thousands separators."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d{3})", ""), F.lit(r"-?\d+(?:\.\d+)?"), 0)
    return F.when(F.size(found) > 0, F.element_at(found, -1).try_cast("double"))


# Phrases that number the items of an order, and words before a step's number.
ORDINALS = ["first|1st|首先|第一步", "second|2nd|其次|第二步", "third|3rd|再次|第三步", "fourth|4th|最后|第四步"]
STEPS = r"step\s*[\d一二三四]+|步骤\s*[\d一二三四]+|第\s*[\d一二三四]\s*步"


def option_sequence(c: Column) -> Column:
    """An order of A to D: the first word of four letters A-D if they differ; else the letters that follow 'first' to
    'fourth' (each new one counts); else those that follow the first four steps. Null if none gives four letters."""
    up = F.upper(c)
    word = F.regexp_extract(up, r"(?U)\b([A-D]{4})\b", 1)
    whole = lambda x: F.when(F.length(x) == 4, x)
    distinct = lambda letters: whole(F.array_join(F.array_distinct(F.filter(letters, lambda x: x != "")), ""))
    ordinal = F.array(*[F.upper(F.regexp_extract(up, f"(?iu)(?:{p}).*?([A-D])", 1)) for p in ORDINALS])
    steps = F.slice(F.regexp_extract_all(up, F.lit(f"(?iu)(?:{STEPS}).*?([A-D])"), 1), 1, 4)
    return F.coalesce(distinct(F.split(word, "")), distinct(ordinal), distinct(F.transform(steps, F.upper)))


def infer_order(answer: Column, kind: Column, options: Column, labels: list[str]) -> Column:
    """An order for rows of kind 'sort', else an option label; where there is none, the option that the text contains."""
    return F.coalesce(F.when(kind == "sort", option_sequence(answer)).otherwise(option_label(answer, labels)), option_text(answer, options))


def number_word(c: Column) -> Column:
    """The whole number of a text; the first number word, from zero to ten, that occurs anywhere in it stands for the text."""
    plain = strip(c)
    out = F.when(plain.rlike(r"^[+-]?\d+(_\d+)*\z"), F.replace(plain, F.lit("_"), F.lit("")).try_cast("int"))
    for value, word in reversed(list(enumerate("zero one two three four five six seven eight nine ten".split()))):
        out = F.when(F.lower(c).contains(word), value).otherwise(out)
    return out


def tsv_plain(c: Column) -> Column:
    """Escapes of a tab-separated value as the characters they stand for."""
    for escaped, plain in (("\\n", "\n"), ("\\p", "|"), ("\\\\", "\\")):
        c = F.replace(c, F.lit(escaped), F.lit(plain))
    return c


def within_tolerance(pred: Column, target: Column, tolerance: Column | None = None) -> Column:
    """|pred - target| under the tolerance; without one, a hundredth of the target with its sign, so no negative target passes."""
    limit = target * 0.01 if tolerance is None else F.coalesce(F.nullif(tolerance, F.lit(0.0)), target * 0.01)
    return F.coalesce(F.abs(pred - target) < limit, F.lit(False))
