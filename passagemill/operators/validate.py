"""Answers from replies: parsing, the ordered checks, and what a user reads in the end."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from passagemill.config import setting
from passagemill.functions import rules as R, text as X
from passagemill.operators import guards as G


def return_claim(text: str) -> str | None:
    """Why a text states a return: a claim outright, or a percentage that no fee explains."""
    for i, p in enumerate(R.RETURN_CLAIMS):
        if re.search(p, text):
            return f"claim_{i}"
    at = [m.start() for m in re.finditer("%", text)]
    for i in at:
        if re.search(R.FEE_WORDS, text[max(0, i - R.FEE_WINDOW) : i]):
            continue
        sentence = re.split(r"[.!?\n]", text[max(0, i - R.RETURN_WINDOW) : i])[-1]
        if re.search(R.RETURN_WORDS, sentence):
            return "percentage_near_return_language"
    return "unexplained_percentage" if at and not re.search(R.FEE_WORDS, text) else None


@F.pandas_udf(T.StringType())
def claims_return(text: pd.Series) -> pd.Series:
    return text.map(lambda t: return_claim(t or ""))


def parse_reply(raw: Column) -> Column:
    """struct(answer, sources, refused, reason) of the first JSON object of a reply; null if there is none."""
    return F.from_json(X.first_json_object(raw), "answer string, sources array<string>, refused boolean, reason string")


def validated(replies: DataFrame, now: Column | None = None) -> DataFrame:
    """Adds kind, reason, answer, sources, last_updated and steps to replies.

    ``replies`` has raw and hits, an array of struct(rank, url, fetched_at, ...) in order of rank. The checks run in
    order: parse, identifiers, returns, citation, provenance, length, freshness; the first that fails decides.
    """
    most, stale_days = setting("generation.max_sentences"), setting("freshness.max_age_days")
    now = F.current_timestamp() if now is None else now
    urls = F.filter(F.transform("hits", lambda h: h["url"]), lambda u: X.blank_if_null(u) != "")
    df = replies.withColumn("_reply", parse_reply(F.col("raw"))).withColumn("_text", X.strip_markdown(F.col("_reply.answer")))
    df = df.withColumn("_pii", G.categories(G.identifiers(F.col("_text")))).withColumn("_claim", claims_return("_text"))
    given = F.coalesce(F.col("_reply.sources"), F.array().cast("array<string>"))
    df = df.withColumn("_given", given).withColumn("_urls", urls)
    df = df.withColumn("_kept", F.filter("_given", lambda s: F.array_contains("_urls", s)))
    df = df.withColumn("_bad", F.size("_given") - F.size("_kept")).withColumn("_sentences", X.sentences(F.col("_text")))
    stamps = lambda only: F.array_max(F.filter(F.transform(F.filter("hits", only), lambda h: h["fetched_at"]), lambda s: X.blank_if_null(s) != ""))
    newest = F.coalesce(stamps(lambda h: F.array_contains("_kept", h["url"])), stamps(lambda h: F.lit(True)), F.lit(""))
    df = df.withColumn("last_updated", newest).withColumn("_stale", F.coalesce(X.age_days(F.col("last_updated"), now) > stale_days, F.lit(False)))
    no_sources, blank = F.size("_given") == 0, F.col("_text") == ""
    end = lambda kind, reason, step: F.struct(F.lit(kind).alias("kind"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(step).alias("step"))
    fail = (
        F.when(F.col("_reply").isNull() | F.col("_reply.answer").isNull(), end("error", "generation_parse_failed", "parse"))
        .when(F.size("_pii") > 0, end("pii_notice", F.concat(F.lit("output_pii:"), F.array_join("_pii", ",")), "pii_output"))
        .when(F.col("_claim").isNotNull(), end("perf_redirect", F.concat(F.lit("c4_block:"), F.col("_claim")), "c4_performance"))
        .when(no_sources & (F.coalesce(F.col("_reply.refused"), F.lit(False)) | blank), end("refusal", "model_refused", "citation_present"))
        .when(no_sources, end("abstain", "no_citation", "citation_present"))
        .when(F.size("_kept") == 0, end("abstain", F.concat(F.lit("citation_provenance_dropped:"), F.col("_bad").cast("string")), "citation_provenance"))
        .when(blank, end("abstain", "empty_answer", "non_empty"))
        .otherwise(end("factual", F.when(F.col("_stale"), "stale_source").otherwise("ok"), "done"))
    )
    df = df.withColumn("_end", fail)
    body = lambda n: F.array_join(F.slice("_sentences", 1, n), " ")
    factual = F.when(F.col("_stale"), F.concat(body(most - 1), F.lit(" " + R.CAVEAT))).when(F.size("_sentences") > most, body(most)).otherwise(F.col("_text"))
    notice = F.element_at(F.create_map(*(F.lit(x) for p in R.NOTICES.items() for x in p)), F.col("_end.kind"))
    is_factual = F.col("_end.kind") == "factual"
    order = ["parse", "pii_output", "c4_performance", "citation_present", "citation_provenance", "non_empty"]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("_end.step"))
    reached = F.when(place == 0, F.array(*map(F.lit, [*order[:5], "sentences", "freshness"]))).otherwise(F.slice(F.array(*map(F.lit, order)), F.lit(1), place.cast("int")))
    ok = lambda s: F.when(s == F.col("_end.step"), F.lit(False)).when(s == "citation_provenance", F.col("_bad") == 0).when(s == "sentences", F.size("_sentences") <= most).when(s == "freshness", ~F.col("_stale")).otherwise(F.lit(True))
    return df.withColumns(
        {
            "kind": F.col("_end.kind"),
            "reason": F.col("_end.reason"),
            "answer": F.when(is_factual, factual).otherwise(notice),
            "sources": F.when(is_factual, F.col("_kept")).when(F.col("_end.kind") == "perf_redirect", F.slice("_urls", 1, 1)).otherwise(F.array().cast("array<string>")),
            "steps": F.transform(reached, lambda s: F.struct(s.alias("step"), ok(s).alias("ok"))),
        }
    ).drop(*(c for c in df.columns if c.startswith("_")))
