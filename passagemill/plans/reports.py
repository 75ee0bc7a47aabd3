"""Small results as text: evaluation, grid of settings, dumps. Each takes at most ``most`` rows to the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from passagemill.functions import text as X


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of at most ``most`` rows; longer results say so in a last line."""
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(lines + (["", f"(more than {most} rows)"] if len(rows) > most else [])) + "\n"


def evaluation(scores: DataFrame, outcomes: DataFrame) -> str:
    return f"# Retrieval\n\n{markdown(scores)}\n## Questions\n\n{markdown(outcomes.orderBy('id'))}"


def grid(cells: DataFrame, winner: DataFrame) -> str:
    ordered = cells.orderBy(F.col("skipped"), F.desc("recall_at_5"), "n_chunks")
    counts = cells.agg(F.count_if(~F.col("skipped")).alias("scored"), F.count_if("skipped").alias("skipped"))
    return f"# Settings\n\n{markdown(counts)}\n{markdown(ordered)}\n## Winner\n\n{markdown(winner)}"


def dump(chunks: DataFrame, most: int = 200) -> str:
    """Passages in order of source and index, with the start of each text."""
    rows = chunks.orderBy("source_id", "chunk_index").select("source_id", "chunk_index", "chunk_id", F.length("text").alias("chars"), X.excerpt(F.col("text"), 80).alias("start"))
    return markdown(rows, most)


def write_back(config: str, values: dict[str, object]) -> str:
    """A YAML text with scalars replaced in place, comments kept; an error, and no change, if any key is missing."""
    for key, value in values.items():
        config, n = re.subn(rf"(?m)^(\s*{re.escape(key)}\s*:\s*)([^#\n]*?)(\s*(?:#.*)?)$", lambda m: f"{m[1]}{value}{m[3]}", config, count=1)
        if not n:
            raise KeyError(key)
    return config
