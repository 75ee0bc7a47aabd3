"""Text functions as column expressions; all but two stay in the JVM."""

from __future__ import annotations

import html
import json

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Abbreviations that end no sentence.
ABBREVIATIONS = "mr mrs ms dr prof sr jr st vs etc no fig approx cf eg ie am pm pvt ltd inc rs min max qty nav aum f&o".split()
# What marks a short line as boilerplate, without names of products.
BOILERPLATE = ("cookie", "all rights reserved", "terms of use", "privacy policy", "disclosure:", "risk disclosures", "know your customer")
BOILERPLATE_LENGTH = 200
#: Fixed: tokens per word that stand in for a word-piece tokenizer, and its two special tokens.
PIECES_PER_WORD, SPECIAL_PIECES = 1.35, 2


def blank_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    """Words between white space; the empty array for a blank or null text."""
    flat = F.trim(F.regexp_replace(blank_if_null(text), r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    """Estimated word pieces of a text."""
    return (F.floor(word_count(text) * PIECES_PER_WORD) + SPECIAL_PIECES).cast("int")


def is_boilerplate(line: Column, markers: tuple[str, ...] = BOILERPLATE) -> Column:
    low = F.lower(line)
    hit = F.lit(False)
    for m in markers:
        hit = hit | low.contains(m)
    return (F.length(line) <= BOILERPLATE_LENGTH) & hit


def clean(text: Column, markers: tuple[str, ...] = BOILERPLATE) -> Column:
    """Text without zero-width characters, runs of space, blank lines and boilerplate lines."""
    t = F.regexp_replace(text, "[​‌‍⁠﻿]", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[\t ]", " ")
    t = F.regexp_replace(t, " {2,}", " ")
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~is_boilerplate(x, markers))
    return F.array_join(lines, "\n")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities as characters."""
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def strip_tags_each(markup: pd.Series) -> pd.Series:
    """``strip_tags`` of every string of an array, which an expression cannot do, as entities need Python."""
    import re

    one = lambda x: re.sub(r"\s+", " ", html.unescape(re.sub(r"(?s)<[^>]+>", " ", x or ""))).strip()
    return markup.map(lambda xs: None if xs is None else [one(x) for x in xs])


def strip_tags(markup: Column) -> Column:
    """Tags to spaces, then entities to characters, then runs of white space to one."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(markup, "(?s)<[^>]+>", " ")), r"(?U)\s+", " "))


def token_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(blank_if_null(text)), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets: 1 if both are empty, 0 if one is."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def normalise_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", " "), " +", " "))


def contains_tokens(text: Column, name: Column) -> Column:
    """Whole-token containment in normalised text."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), name, F.lit(" ")))


# Fixed value: where a sentence ends.
_BREAK = r"(?<=[.!?])[\"'\)\]]*\s+(?=[A-Z\"'\(\[])"


def sentences(text: Column) -> Column:
    """Sentences of a text; a piece that ends with an abbreviation is joined to the next one."""
    guard = r"(?i)\b(" + "|".join(ABBREVIATIONS) + r")\.$"
    pieces = F.filter(F.transform(F.split(blank_if_null(text), _BREAK, -1), lambda x: F.trim(x)), lambda x: x != "")

    def add(done: Column, piece: Column) -> Column:
        return F.when((F.size(done) > 0) & F.try_element_at(done, F.lit(-1)).rlike(guard), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit(" "), piece)))).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), add)


def first_sentences(text: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def strip_markdown(text: Column) -> Column:
    t = F.regexp_replace(blank_if_null(text), r"^\s*```(?:json|text)?\s*", "")
    t = F.regexp_replace(t, r"\s*```\s*$", "")
    t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*[-*•]\s+", "")
    return F.trim(F.regexp_replace(t, "[ \t]{2,}", " "))


def excerpt(text: Column, width: int) -> Column:
    flat = F.trim(F.regexp_replace(blank_if_null(text), r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)


def hash16(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def query_hash(question: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", F.lit(salt), question), 256), 1, 10)


def money(value: Column) -> Column:
    """An amount with thousands separators: whole numbers without, others with two decimals; null for none or zero."""
    number = value.try_cast("double")
    text = F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 2))
    return F.when(value.isNull() | value.isin("", "0"), None).when(number.isNull(), value).otherwise(F.concat(F.lit("Rs "), text))


def yes_no(value: Column) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("true", "yes", "1"), "Yes").when(low.isin("false", "no", "0"), "No").otherwise(F.nullif(F.trim(value), F.lit("")))


def end_stop(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def age_days(stamp: Column, now: Column) -> Column:
    """Days from a time as text to ``now``; null where it can't be read; a time without offset is UTC."""
    return (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(stamp))) / F.lit(86400e6)


def utc_now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _first_object(text: str | None) -> str | None:
    """The first balanced JSON object of a text."""
    if not text:
        return None
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        return text[at:end]
    return None


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    return text.map(_first_object)
