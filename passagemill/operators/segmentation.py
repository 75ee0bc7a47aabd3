"""Documents to passages: sections, splits under a size, token budget, numbering.

Numbering is declarative. Sections are cut and split by Arrow functions over batches: a walk over the lines, and splits
that are recursive and greedy, which no expression can state.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from passagemill.config import setting
from passagemill.functions import text as X

# Separators in the order in which they are tried; starts of lines that say where a page is from.
SEPARATORS = ("\n\n", "\n", ". ", " ")
META_LINES = ("Source page:", "Page title:")


_SPACE = " \t\n\x0b\f\r"
_HEADING = re.compile(rf"(#{{1,6}})[{_SPACE}]+(?=[^{_SPACE}])")


def section_parts(text: str) -> list[tuple[int, list[str], str]]:
    """(section_no, trail, body) of the sections of a text that have a body, in order."""
    out: list[tuple[int, list[str], str]] = []
    no, trail, lines = 0, [], []
    for line in [*text.replace("\r\n", "\n").split("\n"), None]:
        m = None if line is None else _HEADING.match(line)
        if line is None or m:
            body = "\n".join(lines).strip(_SPACE)
            if body:
                out.append((no, trail, body))
            if m:
                no, trail, lines = no + 1, [*trail[: len(m[1]) - 1], line[m.end() :].strip(" ")], []
        elif not line.startswith(META_LINES):
            lines.append(line)
    return out


_SECTION = T.StructType([T.StructField("section_no", T.LongType()), T.StructField("trail", T.ArrayType(T.StringType())), T.StructField("body", T.StringType())])


@F.pandas_udf(T.ArrayType(_SECTION))
def _sections(text: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("section_no", "trail", "body"), s)) for s in section_parts(t)] for t in text])


def sections(docs: DataFrame, key: str = "source_id") -> DataFrame:
    """A row for each section of ``docs`` that has a body: section_no, trail (headings above it) and body.

    A document is walked through where it lies; nothing is shuffled.
    """
    each = docs.where(F.col("text").isNotNull()).select(key, F.explode(_sections("text")).alias("_s"))
    return each.select(key, "_s.section_no", "_s.trail", "_s.body")


def heading_trail(*parts: Column) -> Column:
    """Scheme, page title and headings: trimmed, not empty, each once."""
    flat = F.transform(F.flatten(F.array(*parts)), lambda x: F.trim(X.blank_if_null(x)))
    return F.array_distinct(F.filter(flat, lambda x: x != ""))


def embed_text(trail: Column, body: Column) -> Column:
    return F.when(F.size(trail) > 0, F.concat(F.array_join(trail, " > "), F.lit("\n\n"), body)).otherwise(body)


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The first separator that occurs divides the text; what is still too long is divided by those after it."""
    text = text.strip()
    if len(text) <= size:
        return [text] if text else []
    present = next((i for i, s in enumerate(separators) if s in text), None)
    if present is None:
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts: list[str] = []
    for piece in filter(None, (p.strip() for p in text.split(separators[present]))):
        parts += [piece] if len(piece) <= size else split_recursively(piece, size, overlap, separators[present + 1 :])
    return pack_with_overlap(parts, size, overlap)


def pack_with_overlap(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts joined up to the size; each window starts with whole parts of the one before, at least ``overlap`` long.

    Without overlap the parts stay as they are.
    """
    if overlap <= 0:
        return parts
    out: list[list[str]] = []
    window: list[str] = []
    width = 0  # of the window when joined
    for part in parts:
        if window and width + 1 + len(part) > size:
            out.append(window)
            back, carried = len(window), 0
            while back > 0 and carried < overlap:
                back -= 1
                carried += len(window[back]) + 1
            window = window[back:]
            width = sum(map(len, window)) + max(len(window) - 1, 0)
            width += len(part) + 1  # a window is never empty here, as the overlap is positive
        else:
            width += len(part) + (1 if window else 0)
        window = [*window, part]
    return [" ".join(w) for w in ([*out, window] if window else out)]


def _sentences(text: str) -> list[str]:
    guard = re.compile(r"\b(" + "|".join(X.ABBREVIATIONS) + r")\.$", re.I)
    out: list[str] = []
    for piece in filter(None, (p.strip() for p in re.split(X._BREAK, text))):
        if out and guard.search(out[-1]):
            out[-1] += " " + piece
        else:
            out.append(piece)
    return out


def pack_sentences(text: str, size: int) -> list[str]:
    """Whole sentences joined up to the size; a longer sentence is cut hard."""
    out, held = [], ""
    for s in _sentences(text) or [text]:
        if held and len(held) + 1 + len(s) > size:
            out.append(held)
            held = ""
        if len(s) + (1 if held else 0) > size:
            if held:
                out.append(held)
                held = ""
            out += [s[i : i + size] for i in range(0, len(s), size)]
        else:
            held = f"{held} {s}" if held else s
    return [p for p in [*out, held] if p.strip()]


def pack_words(text: str, size: int) -> list[str]:
    """Words joined up to the size; a longer word stays whole."""
    out, held = [], ""
    for w in text.split():
        if held and len(held) + 1 + len(w) > size:
            out.append(held)
            held = ""
        held = f"{held} {w}" if held else w
    return [*out, held] if held else out


def estimate(text: str) -> int:
    return int(len(text.split()) * X.PIECES_PER_WORD) + X.SPECIAL_PIECES


def _split_column(split: Callable[[str], list[str]]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(body: pd.Series) -> pd.Series:
        return body.map(lambda b: split(b or ""))

    return run


def semantic_groups(sentence_list: list[str], vectors: np.ndarray, size: int, threshold: float = 0.35, quantile: float = 0.75) -> list[str]:
    """Neighbouring sentences joined until their vectors part or the size is reached; few sentences stay together."""
    if len(sentence_list) < 3:
        return [" ".join(sentence_list)] if sentence_list else []
    distance = 1 - (vectors[:-1] * vectors[1:]).sum(1)
    breaks = distance > threshold
    if not breaks.any():
        breaks = distance > np.quantile(distance, quantile)
    groups: list[list[str]] = [[sentence_list[0]]]
    for s, new in zip(sentence_list[1:], breaks):
        if new or len(" ".join(groups[-1])) + 1 + len(s) > size:
            groups.append([s])
        else:
            groups[-1].append(s)
    return [p for g in groups for p in (pack_sentences(" ".join(g), size) if len(" ".join(g)) > size else [" ".join(g)])]


def _semantic(size: int, overlap: int):
    from passagemill.operators.vectors import hashing_vectors

    def split(body: str) -> list[str]:
        s = _sentences(body)
        return semantic_groups(s, hashing_vectors(s), size) if s else []

    return split


#: Strategies by name. ``heading_bound`` keeps a section whole where it fits, which ``recursive`` does as well.
STRATEGIES: dict[str, Callable[[int, int], Callable[[str], list[str]]]] = {
    "recursive": lambda size, overlap: lambda body: split_recursively(body, size, overlap),
    "heading_bound": lambda size, overlap: lambda body: split_recursively(body, size, overlap),
    "semantic": _semantic,
}


def strategy(name: str, size: int, overlap: int):
    if name not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {name}")
    return _split_column(STRATEGIES[name](size, overlap))


def alike(name: str, size: int, overlap: int) -> tuple[str, int, int]:
    """The setting that stands for all those which split as this one does: see ``STRATEGIES``."""
    return ("semantic", size, 0) if name == "semantic" else ("recursive", size, overlap)


def passages(docs: DataFrame, name: str | None = None, size: int | None = None, overlap: int | None = None, key: str = "source_id") -> DataFrame:
    """Passages of documents with their provenance, numbered from 0 in each document; tiny pieces are dropped first."""
    size = size or setting("chunking.chunk_size")
    overlap = setting("chunking.chunk_overlap") if overlap is None else overlap
    split = strategy(name or setting("chunking.strategy"), size, overlap)
    pieces = sections(docs, key).select(key, "section_no", "trail", F.posexplode(split(F.col("body"))).alias("piece_no", "text"))
    pieces = pieces.where(X.word_count(F.col("text")) >= setting("chunking.min_words"))
    pieces = pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("section_no", "piece_no")) - 1)
    meta = docs.drop("text", "content_hash", "section_no", "trail", "body", "chunk_index")
    whole = pieces.join(meta, key)
    return _described(whole.withColumn("heading_trail", heading_trail(F.array("scheme_name"), F.array("page_title"), F.col("trail"))), key)


def _described(p: DataFrame, key: str) -> DataFrame:
    """Ids, hashes, lengths and the text to encode of numbered passages."""
    return p.withColumns(
        {
            "chunk_id": X.hash16(F.col(key).cast("string"), F.col("chunk_index").cast("string")),
            "embed_text": embed_text(F.col("heading_trail"), F.col("text")),
            "char_len": F.length("text"),
            "word_count": X.word_count(F.col("text")),
            "content_hash": F.substring(F.sha2("text", 256), 1, 16),
        }
    ).drop("section_no", "piece_no", "trail")


def rescue(text: str, cap: int, target: int) -> tuple[list[str], int]:
    """Pieces of an over-long passage that fit the budget, and how many did not."""
    width = max(120, int(target / X.PIECES_PER_WORD))
    kept: list[str] = []
    lost = 0
    for piece in pack_sentences(text, width):
        for part in [piece] if estimate(piece) <= cap else pack_words(piece, width):
            if estimate(part) <= cap:
                kept.append(part)
            else:
                lost += 1
    return kept, lost


def enforce_budget(chunks: DataFrame, cap: int | None = None, target: int | None = None, key: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """(passages within the budget, renumbered; one row of counters: kept, rescued, dropped, violations).

    The budget holds for the text that is encoded, headings included.
    """
    cap, target = cap or setting("chunking.max_wordpieces"), target or setting("chunking.target_wordpieces")

    @F.pandas_udf("pieces array<string>, lost int")
    def salvage(text: pd.Series, over: pd.Series) -> pd.DataFrame:
        done = [rescue(t, cap, target) if o else ([t], 0) for t, o in zip(text, over)]
        return pd.DataFrame({"pieces": [d[0] for d in done], "lost": [d[1] for d in done]})

    over = X.token_estimate(F.col("embed_text")) > cap
    fixed = chunks.withColumn("_over", over).withColumn("_fixed", salvage("text", "_over"))
    none_left = F.col("_over") & (F.size("_fixed.pieces") == 0)
    lost = (F.col("_fixed.lost") + none_left.cast("int")).cast("long")
    report = fixed.agg(
        F.coalesce(F.sum(F.size("_fixed.pieces")), F.lit(0)).alias("kept"),
        F.count_if(F.col("_over") & (F.size("_fixed.pieces") > 0)).alias("rescued"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("dropped"),
        F.coalesce(F.sum(lost), F.lit(0)).alias("violations"),
    )
    pieces = fixed.select(*(c for c in chunks.columns if c != "text"), F.posexplode("_fixed.pieces").alias("_piece", "text"))
    renumbered = pieces.withColumn("chunk_index", F.row_number().over(Window.partitionBy(key).orderBy("chunk_index", "_piece")) - 1).drop("_piece")
    return _described(renumbered, key), report
