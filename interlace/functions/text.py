"""Scalar functions over text, numbers and references as column expressions; Python only where Spark has no equal."""

from __future__ import annotations

import difflib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words too common to tell parts apart.
STOP_WORDS = [
    "the", "and", "for", "with", "from", "this", "that", "are", "has", "not", "will", "each", "also", "your", "its", "per", "new", "all", "inc",
    "nos", "qty", "pcs", "part", "parts", "item", "oem", "fits",
]
# Vehicle makes.
MAKES = [
    "Acura", "Audi", "BMW", "Buick", "Cadillac", "Chevrolet", "Chevy", "Chrysler", "Dodge", "Ford", "GMC", "Honda", "Hyundai", "Infiniti", "Jeep",
    "Kia", "Lexus", "Lincoln", "Mazda", "Mercedes", "Mercury", "Mitsubishi", "Nissan", "Pontiac", "Subaru", "Suzuki", "Toyota", "Volkswagen", "VW",
    "Volvo",
]
# Words that look like references but are page furniture.
NOT_REFERENCES = [
    "INCLUDES", "THERMOSTAT", "WARRANTY", "INFORMATION", "DETAILS", "MONTHS", "MILES", "LIMITED", "LIFETIME", "PLEASE", "CONTACT", "NUMBER", "RETURN",
    "POLICY",
]
# Signs and what stands for them in plain text.
PLAIN_SIGNS = {
    "™": "TM", "®": "(R)", "©": "(C)", "°": " deg ", "—": " - ", "–": " - ", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "…": "...",
    "【": "[", "】": "]", "🎯": "[TARGET]", "🔧": "[TOOL]", "⚙\ufe0f": "[GEAR]",
}
# Cells that count as blank.
BLANKS = ("", "n/a", "na", "none", "-", "--", "0", ".", "tbd", "?")


def is_blank(c: Column) -> Column:
    """null or one of the placeholders."""
    return c.isNull() | F.lower(F.trim(c)).isin(*BLANKS)


def words(text: Column) -> Column:
    """Distinct lower-case runs of three or more letters A to Z; none for null."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]{3,}"), F.lit(0)), F.lower))


def telling_words(text: Column) -> Column:
    return F.array_except(words(text), F.array(*map(F.lit, STOP_WORDS)))


def numbers(text: Column) -> Column:
    """Unsigned numbers in a text, as doubles."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double"))


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def normal_reference(ref: Column) -> Column:
    """Upper case without blanks and dashes."""
    return F.regexp_replace(F.upper(F.trim(ref)), "[ -]", "")


def base_reference(ref: Column) -> Column:
    """A normal reference without its one or two last letters."""
    return F.regexp_replace(normal_reference(ref), "[A-Z]{1,2}$", "")


def is_reference(ref: Column) -> Column:
    """six to fifteen letters, digits or dashes, and no word of page furniture."""
    t = F.trim(ref)
    return F.coalesce(t.rlike("^[A-Za-z0-9-]{6,15}$") & ~F.upper(t).isin(*NOT_REFERENCES), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays; null if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def parse_price(text: Column) -> Column:
    """C14: a number out of '$1,234.50'; null for anything else."""
    return F.regexp_replace(text, "[$, ]", "").try_cast("double")


def parse_confidence(text: Column) -> Column:
    """A number is truncated, else the first run of digits counts; null without one."""
    return F.coalesce(F.floor(text.try_cast("double")).cast("int"), F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int"))


def parse_time(text: Column) -> Column:
    """Four formats in turn; null for anything else."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "M/d/yyyy H:m")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def grade(score: Column) -> Column:
    """A to F."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def verdict(confidence: Column, category_score: Column) -> Column:
    """The verdict of a confidence; a category that contradicts means NO."""
    return F.when(category_score == 0, "NO").when(confidence >= 80, "YES").when(confidence >= 60, "LIKELY").when(confidence >= 35, "UNCERTAIN").otherwise("NO")


def expand_years(text: Column) -> Column:
    """C17: the years of '2005-2010' or '2007'; none for anything else."""
    first, last = F.regexp_extract(text, r"^\s*(\d{4})", 1).try_cast("int"), F.regexp_extract(text, r"-\s*(\d{4})\s*$", 1).try_cast("int")
    last = F.coalesce(last, first)
    return F.when(text.rlike(r"^\s*\d{4}(\s*-\s*\d{4})?\s*$") & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def image_kind(name: Column) -> Column:
    """Small, large, medium or diagram, by the marks in a file name."""
    n = F.lower(name)
    return F.when(n.contains("ra_s"), "small").when(n.contains("ra_l"), "large").when(n.contains("ra_m"), "medium").when(n.contains("diagram"), "diagram").otherwise("other")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's ratio 2M/T, which no built-in function has; for the pairs that nothing else decides."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


#: Texts up to this length are matched by plain searches; beyond it difflib's index of characters is the faster way.
SHORT = 32


def matching(a: str, b: str) -> int:
    """The characters in the matching blocks of two short texts, as difflib finds them: the longest block, the first in a and then
    in b among equals, and so on to its left and right. Several times as fast as difflib's general way for some ten characters."""
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        for size in range(min(ahi - alo, bhi - blo), 0, -1):
            for i in range(alo, ahi - size + 1):
                if (j := b.find(a[i : i + size], blo, bhi)) >= 0:
                    break
            else:
                continue
            total += size
            todo += ((alo, i, blo, j), (i + size, ahi, j + size, bhi))
            break
    return total


def greater_ratio(a: str, b: str) -> float:
    """The greater ratio of two different texts over both orders; the second is left out where the first has all that can match."""
    if max(len(a), len(b)) > SHORT:
        return max(difflib.SequenceMatcher(None, x, y).ratio() for x, y in ((a, b), (b, a)))
    most = min(len(a), len(b)) - (len(a) == len(b))
    got = matching(a, b)
    return 2.0 * (got if got >= most else max(got, matching(b, a))) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def either_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greater of the ratios of different texts in both orders."""
    return pd.Series([greater_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _plain(text: str) -> str:
    """Compatibility forms resolved, known signs spelled out, what cp1252 lacks dropped, white space collapsed."""
    text = unicodedata.normalize("NFKD", text)
    for sign, spelled in PLAIN_SIGNS.items():
        text = text.replace(sign, spelled)
    return " ".join(text.encode("cp1252", "ignore").decode("cp1252").split())


def _plain_value(value: object) -> object:
    """Every string inside a parsed JSON value in plain text, keys included; of keys that become equal the last one stays."""
    if isinstance(value, str):
        return _plain(value)
    if isinstance(value, list):
        return [_plain_value(v) for v in value]
    if isinstance(value, dict):
        return {_plain(k): _plain_value(v) for k, v in value.items()}
    return value


@F.pandas_udf(T.StringType())
def plain_text(texts: pd.Series) -> pd.Series:
    """Plain text that cp1252 can hold; empty for null."""
    return texts.map(lambda t: "" if t is None else _plain(t))


@F.pandas_udf(T.StringType())
def plain_json(texts: pd.Series) -> pd.Series:
    """A JSON value with every string in it in plain text, at any depth; numbers, nulls and booleans stay.

    Null stays null. What is no JSON, or is nested beyond the parser's depth, is taken as a text itself.
    """
    def one(t):
        try:
            return None if t is None else json.dumps(_plain_value(json.loads(t)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return _plain(t)

    return texts.map(one)
