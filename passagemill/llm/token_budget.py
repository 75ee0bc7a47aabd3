"""How many tokens each slice of a collection holds.

Token counts come from the counting automaton in the tasks of the scan; only counts and slice names are shuffled.

Defined results: spellings of one slice count together (case and white space of names; region and case of a lang code,
``en-IN`` and ``EN`` are ``en``); a null or blank slice is ``unknown``; null and empty texts count as texts of 0 tokens;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagemill.llm.encode import count_tokens

UNKNOWN = "unknown"
#: Language codes that say nothing.
UNDETERMINED = ("und", "unk", "xx", "zxx")


def slice_name(name: Column) -> Column:
    """One spelling for all spellings of a name."""
    flat = F.trim(F.regexp_replace(F.lower(name), r"(?U)\s+", " "))
    return F.when(F.coalesce(flat, F.lit("")) == "", UNKNOWN).otherwise(flat)


def language(code: Column) -> Column:
    """The primary part of a language code in lower case."""
    base = F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(F.coalesce(base, F.lit("")).isin("", *UNDETERMINED), UNKNOWN).otherwise(base)


def token_cube(counts: DataFrame, slices: list[str]) -> DataFrame:
    """Texts and tokens of every combination of ``slices`` and of every total; ``level`` has a bit per slice that is
    summed over, which is then null."""
    return counts.cube(*slices).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens")
    )


def document_budget(documents: DataFrame, **vocabulary: str) -> DataFrame:
    """Cube of (source, lang, domain) over all documents."""
    counts = count_tokens(documents, ["source", "lang", "domain"], **vocabulary)
    return token_cube(
        counts.select(slice_name(F.col("source")).alias("source"), language(F.col("lang")).alias("lang"), slice_name(F.col("domain")).alias("domain"), "n_tokens"),
        ["source", "lang", "domain"],
    )


def passage_budget(chunk: DataFrame, **vocabulary: str) -> DataFrame:
    """Cube of (source_id, scheme_name, lang) over the current passages: of the last snapshot, the row fetched last."""
    last = chunk.agg(F.max("snapshot_no").alias("snapshot_no"))
    keep = ["chunk_id", "source_id", "scheme_name", "lang", "fetched_at", "snapshot_no"]
    # texts are counted where they are read; the choice of the current row then moves counts only
    counts = count_tokens(chunk.join(F.broadcast(last), "snapshot_no", "left_semi"), keep, **vocabulary)
    row = F.struct(F.try_to_timestamp("fetched_at").alias("at"), "source_id", "scheme_name", "lang", "n_tokens")
    current = counts.groupBy("chunk_id").agg(F.max(row).alias("row")).select("row.*")
    return token_cube(
        current.select(slice_name(F.col("source_id")).alias("source_id"), slice_name(F.col("scheme_name")).alias("scheme_name"), language(F.col("lang")).alias("lang"), "n_tokens"),
        ["source_id", "scheme_name", "lang"],
    )


def token_budget(documents: DataFrame, chunk: DataFrame, **vocabulary: str) -> DataFrame:
    """Both cubes in one table; slices that a table doesn't have are null."""
    of_documents = document_budget(documents, **vocabulary).select(
        F.lit("documents").alias("table_name"), "source", F.lit(None).cast("string").alias("scheme_name"), "lang", "domain", "level", "n_texts", "n_tokens"
    )
    of_passages = passage_budget(chunk, **vocabulary).select(
        F.lit("chunk").alias("table_name"), F.col("source_id").alias("source"), "scheme_name", "lang", F.lit(None).cast("string").alias("domain"), "level", "n_texts", "n_tokens"
    )
    return of_documents.unionByName(of_passages)
