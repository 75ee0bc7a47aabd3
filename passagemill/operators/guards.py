"""Guards as columns: named pattern rules, identifiers in text, and the route of a question."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from passagemill.functions import rules as R, text as X

_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType())]))


def matching(text: Column, table: dict[str, str]) -> Column:
    """Names of all rules that match, in the order of the table."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), name) for name, p in table.items())))


def first_match(text: Column, table: dict[str, str]) -> Column:
    out = None
    for name, p in table.items():
        out = F.when(text.rlike(p), name) if out is None else out.when(text.rlike(p), name)
    return out


def injection(text: Column) -> Column:
    return matching(X.blank_if_null(text), R.INJECTION)


def split_safe(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with text that tries to steer a model)."""
    flagged = rows.withColumn("_rules", injection(F.col(text)))
    return flagged.where(F.size("_rules") == 0).drop("_rules"), flagged.where(F.size("_rules") > 0).drop("_rules")


_IDENTIFIERS = [(n, re.compile(p)) for n, p in R.IDENTIFIERS.items()]
_NUMBERS = [re.compile(p) for p in R.LONG_NUMBERS]


def number_kind(text: str, start: int, end: int) -> str:
    """Whether a long number is an account or a phone number, from the words before it."""
    before, own = text[max(0, start - R.NUMBER_WINDOW) : start], text[start:end]
    if re.search(R.ACCOUNT_WORDS, before):
        return "account"
    digits = sum(map(str.isdigit, re.sub(r"^\s*\+?91[\s\-.]?", "", own)))
    if re.search(R.PHONE_WORDS, before) or re.search(R.PHONE_WORDS, own) or digits == R.NATIONAL_DIGITS and re.search(R.NUMBER_WORDS, before):
        return "phone"
    return "account"


def identifier_spans(text: str) -> list[tuple[int, int, str]]:
    """Identifiers in the order of the rules; one that lies within an earlier one is dropped."""
    out: list[tuple[int, int, str]] = []

    def add(a: int, b: int, name: str) -> None:
        if not any(x <= a and b <= y for x, y, _ in out):
            out.append((a, b, name))

    for name, pattern in _IDENTIFIERS:
        for m in pattern.finditer(text):
            add(*m.span(), name)
    for pattern in _NUMBERS:
        for m in pattern.finditer(text):
            add(*m.span(), number_kind(text, *m.span()))
    return out


@F.pandas_udf(_SPAN)
def _spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b, "name": n} for a, b, n in identifier_spans(t or "")])


def identifiers(text: Column) -> Column:
    """Array of (start, end, name); texts without a digit or an @ never leave the JVM's fast path of an empty array."""
    return F.when(X.blank_if_null(text).rlike(r"[0-9@]"), _spans(text)).otherwise(F.array().cast(_SPAN))


def categories(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: s["name"]))


def redact(text: Column, spans: Column) -> Column:
    """Text with a marker for each identifier, replaced from the last place to the first."""
    ordered = F.reverse(F.array_sort(spans))

    def replace(t: Column, s: Column) -> Column:
        return F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("[REDACTED:"), s["name"], F.lit("]"), F.substring(t, s["end"] + 1, F.length(t)))

    return F.aggregate(ordered, text, replace)


def describe(names: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for p in R.CATEGORY_LABELS.items() for x in p))
    return F.array_join(F.transform(names, lambda n: F.coalesce(F.element_at(labels, n), n)), ", ")


def mentions(question: Column) -> Column:
    """Normalised names of funds that a question mentions."""
    return F.transform(F.regexp_extract_all(X.blank_if_null(question), F.lit(R.FUND_MENTION), F.lit(1)), X.normalise_name)


def _tokens(name: Column) -> Column:
    return F.filter(F.split(name, " "), lambda w: w != "")


def is_listed(mention: Column, names: Column) -> Column:
    """Whether the words of a mention are among the words of one known name."""
    return (F.size(_tokens(mention)) > 0) & F.exists(names, lambda n: F.size(F.array_except(_tokens(mention), _tokens(n))) == 0)


def detect_scheme(question: Column, schemes: list[tuple[str, str]]) -> Column:
    """The scheme (slug, name) with the shortest name that holds all words of a mention; the first of equals."""
    known = F.array(*(F.struct(F.lit(len(set(re.sub("[^a-z0-9 ]", " ", name.lower()).split()))).alias("size"), F.lit(i).alias("no"), F.lit(slug).alias("slug"), F.lit(" ".join(re.sub("[^a-z0-9 ]", " ", name.lower()).split())).alias("name")) for i, (slug, name) in enumerate(schemes)))
    fits = F.flatten(F.transform(mentions(question), lambda m: F.filter(known, lambda k: (F.size(_tokens(m)) > 0) & (F.size(F.array_except(_tokens(m), _tokens(k["name"]))) == 0))))
    return F.try_element_at(F.array_sort(fits), F.lit(1))["slug"]


def route(question: Column, names: list[str]) -> Column:
    """struct(kind, label, matched): the first tier that applies. ``names`` are the known scheme names and aliases."""
    q = F.trim(X.blank_if_null(question))
    known = F.array(*(F.lit(" ".join(re.sub("[^a-z0-9 ]", " ", n.lower()).split())) for n in names))
    flat = X.normalise_name(q)
    named = F.exists(known, lambda n: X.contains_tokens(flat, n))
    unlisted = F.exists(mentions(q), lambda m: ~is_listed(m, known))
    s = lambda kind, label, matched: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), matched.alias("matched"))
    out = F.when(q == "", s("abstain", "empty", F.lit("empty")))
    for kind, label, table in (("refusal", "advice_request", R.ADVICE), ("perf_redirect", "performance_request", R.PERFORMANCE), ("abstain", "out_of_corpus", R.ABSENT)):
        for rule, p in table.items():
            out = out.when(q.rlike(p), s(kind, label, F.lit(rule)))
    out = out.when(unlisted, s("abstain", "out_of_corpus", F.lit("unlisted_scheme")))
    out = out.when(~named & ~q.rlike(R.TOPICS), s("abstain", "out_of_corpus", F.lit("off_topic")))
    return out.otherwise(s("factual", "", F.lit("")))
