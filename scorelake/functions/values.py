"""Answers read off tables: texts as typed values, sets of them compared, amounts with units. All as Column expressions.

A value is struct<kind, text, amount, date>: kind is number, date or text; text is the normalised text, which every value has;
amount is a number's, date a date's year, month and day with -1 for a part that is left open. Null gives null.
Digits are ASCII ones; numbers beyond the range of a double are texts; whole numbers beyond 2**53 compare as doubles.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from .geometry import _let
from .text import SPACE, number, single_spaced, strip, tsv_plain

# Units that an amount is written with, and what multiplies it.
UNITS = ["dollar", "gallons", "square feet", "shares", "mbtu", "mbpd", "mbbls", "mmbtu", "unit", "gwh", "year", "mmcf", "mile", "mboe"]
POWERS = {r" ?\bthousand\b": "e3", r" ?\bmillion\b": "e6", r" ?\bbillion\b": "e9", r" ?%": "e-2"}
#: What may stand behind a value, any number of times and in any order, in a text read from its end: notes in brackets, signs of
#: footnotes, details in parentheses, white space. A note that is the whole text goes only if it is a number.
_BEHIND = rf"^(?:\][^\]]*\[(?!\z)|\]\d+\[|[•♦†‡*#+]|\)[^)]*\( (?!\z)|{SPACE})*+"


#: Quotes and dashes, and what stands for them.
_MARKS = ("‘’“”‐‑‒–—−", "''\"\"------")
#: A whole number as a part of a date.
_PART = rf"{SPACE}*\+?\d+(?:_\d+)*{SPACE}*"


@lru_cache(None)
def _folded() -> tuple[str, str, str, str]:
    """Compatibility decompositions without their marks: letters with a single one, these in the same order, those with
    several, and a JSON map of them. Hangul syllables stay whole."""
    single, plain, several = [], [], {}
    for at in (*range(0x80, 0xAC00), *range(0xF900, 0x2FA20)):
        c = chr(at)
        if unicodedata.category(c) == "Mn":
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn")
        if len(d) == 1 and d != c:
            single.append(c)
            plain.append(d)
        elif len(d) > 1:
            several[c] = d
    return "".join(single), "".join(plain), "".join(several), json.dumps(several)


def fold(c: Column) -> Column:
    """Letters without their accents and other marks, ligatures and the like as plain letters."""
    single, plain, several, each = _folded()
    one = F.from_json(F.lit(each), "map<string,string>")
    less = lambda x: F.translate(x, several, "") != x  # noqa: E731  (a look-up for each letter, where a class would be a search)
    letters = F.filter(F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7f]+", ""), "")), less)
    spelt = F.aggregate(letters, c, lambda acc, x: F.replace(acc, x, F.element_at(one, x)))
    wide = F.translate(F.when(less(c), spelt).otherwise(c), single, plain)
    return F.regexp_replace(wide, r"\p{Mn}+", "")


def table_text(c: Column) -> Column:
    """Folded, with plain quotes and dashes; without notes, details in parentheses and outer quotation marks, in whatever order
    they stand; without one full stop at the end; in lower case, with single spaces."""
    plain = F.replace(_let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.translate(fold(x), *_MARKS)).otherwise(x)), F.lit("`"), F.lit("'"))

    # quotation marks go once at most, as none may stand inside; each pass from the end takes all that stands behind
    bare = lambda x: F.reverse(F.regexp_replace(F.reverse(strip(x)), _BEHIND, ""))
    last = lambda x: F.substring(x, -1, 1)
    inner = _let(strip(plain), lambda x: F.when(last(x).isin(*'])"•♦†‡*#+'), strip(bare(F.regexp_replace(bare(x), r'^"([^"]*)"\z', "$1")))).otherwise(x))
    stopped = _let(inner, lambda x: F.when(last(x) == ".", F.left(x, F.length(x) - 1)).otherwise(x))
    return F.lower(strip(single_spaced(stopped)))


def _date(c: Column) -> Column:
    """year-month-day, with xx (or xxxx, for a year) for parts that are open, but not all of them."""
    read = lambda p: F.when(p.startswith("x"), -1).otherwise(F.regexp_replace(p, r"\D", "").try_cast("bigint"))

    def fine(v: Column) -> Column:
        y, m, d = (F.get(v, F.lit(k)) for k in range(3))
        return y.isNotNull() & ((m == -1) | m.between(1, 12)) & ((d == -1) | d.between(1, 31)) & ~((y == -1) & (m == -1) & (d == -1))

    parts = F.filter(F.array(F.transform(F.split(F.lower(c), "-"), read)), fine)
    return F.when(c.rlike(rf"(?i)^(?:xx|xxxx|{_PART})-(?:xx|{_PART})-(?:xx|{_PART})\z"), F.get(parts, F.lit(0)))


def value(c: Column) -> Column:
    """A text as a typed value. A date of a year alone is a number, an amount within a millionth of a whole one is cut to one."""

    def told(n: Column, date: Column) -> Column:
        year = F.when((F.get(date, F.lit(1)) == -1) & (F.get(date, F.lit(2)) == -1), F.get(date, F.lit(0)).cast("double"))
        whole = (F.abs(n) < 2.0**53) & (F.abs(n - F.rint(n)) < 1e-6)
        amount = F.coalesce(F.when(whole, F.signum(n) * F.floor(F.abs(n)) + F.lit(0.0)).otherwise(n), year)
        dated = F.when(amount.isNull(), date)
        kind = F.when(amount.isNotNull(), "number").when(dated.isNotNull(), "date").otherwise("text")
        return F.struct(kind.alias("kind"), table_text(c).alias("text"), amount.alias("amount"), dated.alias("date"))

    n = _let(number(c), lambda x: F.when(F.abs(x) < float("inf"), x))
    return F.when(c.isNotNull(), _let(F.struct(n.alias("n"), _date(c).alias("d")), lambda x: told(x["n"], x["d"])))


def same_value(a: Column, b: Column) -> Column:
    """Equal normalised texts, numbers less than a millionth apart, or equal dates."""
    return (a["text"] == b["text"]) | F.coalesce(F.abs(a["amount"] - b["amount"]) < 1e-6, F.lit(False)) | F.coalesce(a["date"] == b["date"], F.lit(False))


def value_set(texts: Column) -> Column:
    """Typed values of an array of texts, each once: the first of equal amounts, equal dates or equal normalised texts."""
    key = lambda v: F.concat_ws(":", v["kind"], F.coalesce(v["amount"].cast("string"), F.array_join(v["date"].cast("array<string>"), "-"), v["text"]))
    first = lambda v, keys: F.filter(v, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    return _let(F.transform(texts, value), lambda v: _let(F.transform(v, key), lambda keys: first(v, keys)))


def denotation(c: Column) -> Column:
    """The value set of a text that lists values between | (or ||), with escaped line ends, bars and backslashes."""
    return value_set(F.transform(F.split(F.replace(c, F.lit("||"), F.lit("|")), r"\|"), tsv_plain))


def same_denotation(pred: Column, target: Column) -> Column:
    """As many values on both sides, and every one of the target's equal to one of the prediction's. Null sets match nothing."""
    every = F.forall(target, lambda t: F.exists(pred, lambda p: same_value(t, p)))
    return F.coalesce((F.size(pred) == F.size(target)) & every, F.lit(False))


def apart(pred: Column, target: Column) -> Column:
    """Do both texts list one value, the same text, that no way to write a number or date can be equal to? Not so if in doubt."""
    odd = lambda x: number(x).isNotNull() | _date(x).isNotNull() | x.rlike(r"(?i)^[+-]?(inf|infinity|nan)\z")
    told = lambda v: (v["p"] == v["t"]) & ~odd(v["t"]) & ~odd(pred) & ~odd(target)
    same = _let(F.struct(table_text(pred).alias("p"), table_text(target).alias("t")), told)
    return F.coalesce(~F.concat(pred, target).rlike(r"[|\\]") & same, F.lit(False))


def amount(c: Column) -> Column:
    """struct<exact, plain>, each struct<number, text>: what a text with units says, with its power of ten or per cent worked in
    and without it. Both are texts if either is no number."""
    unit = r"(?U)\b(" + "|".join(UNITS) + r")s?\b"
    bare = F.regexp_replace(F.regexp_replace(table_text(c), r"[$(),]", ""), unit, "")

    def powers(x: Column, worked: bool) -> Column:
        for pattern, power in POWERS.items():
            x = F.regexp_replace(x, "(?U)" + pattern, power if worked else "")
        return x

    def real(x: Column) -> Column:
        odd = F.when(strip(x).rlike(r"^[+-]?(inf|infinity|nan)\z"), F.regexp_replace(strip(x), r"^[+-]?nan\z", "NaN").try_cast("double"))
        return F.coalesce(number(x), odd)

    def told(x: Column) -> Column:
        both = x["a"].isNotNull() & x["b"].isNotNull()
        side = lambda n, s: F.struct(F.when(both, x[n]).alias("number"), F.when(~both, x[s]).alias("text"))
        return F.struct(side("a", "s").alias("exact"), side("b", "t").alias("plain"))

    texts = lambda x: F.struct(powers(x, True).alias("s"), powers(x, False).alias("t"))
    read = lambda x: F.struct(x["s"], x["t"], real(x["s"]).alias("a"), real(x["t"]).alias("b"))
    return F.when(c.isNotNull(), _let(bare, lambda x: _let(texts(x), lambda y: _let(read(y), told))))


def same_amount(pred: Column, target: Column) -> Column:
    """struct<exact, relieved>: do amounts agree as they are said, or at least with or without their power of ten?"""
    equal = lambda p, t: F.coalesce(~F.isnan(p["number"]) & (p["number"] == t["number"]), p["text"] == t["text"], F.lit(False))
    sides = lambda v: F.array(v["exact"], v["plain"])
    relieved = lambda p, t: F.exists(sides(p), lambda x: F.exists(sides(t), lambda y: equal(x, y)))
    told = lambda v: F.struct(equal(v["p"]["exact"], v["t"]["exact"]).alias("exact"), F.coalesce(relieved(v["p"], v["t"]), F.lit(False)).alias("relieved"))
    return _let(F.struct(pred.alias("p"), target.alias("t")), told)
