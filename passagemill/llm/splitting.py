"""Splitting texts that are too long at natural boundaries.

A text is divided into sections at its headings. A section over the limit is cut into pieces: the strength of every
possible cut is known from the characters around it, a sparse table over the strengths answers "the strongest cut of
this window, the last one among equals" in constant time, and every piece after the first starts a little before the
end of the one before it, again at the strongest place of a window.

Defined results: a line end is a line feed with or without a carriage return before it and counts as one character;
white space around a section does not count and does not come out; sections without other characters give no piece; a
section within the limit is one piece; null and empty texts give no rows; a run without any natural place is cut at
the limit, though never before a mark that combines with the character before it if that can be avoided; pieces are
exact substrings, so that without their overlaps they join to the section; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from passagemill.session import spread

#: Characters of a piece at most; characters repeated at most; a piece is at least this share of the limit if it can be.
LIMIT = 1200
OVERLAP = 120
LEAST_SHARE = 0.5

# strengths of a cut, from the weakest; 0 is left for places where a mark would be torn from its letter
BARE, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(1, 7)
_HEADING = regex.compile(r"^(#{1,6}) ([^\n]*)", regex.M)
_PLACES = (
    (SPACE, regex.compile(r"\s+")),
    (CLAUSE, regex.compile(r"[,;:،、](?:\s+|(?<=、))|\s+(?=[-–—(|]\s?)")),
    (SENTENCE, regex.compile(r"(?<![\s.]\p{Lu}|\b(?:Dr|Mr|Ms|St|vs|No|Rs))[.!?](?:[\"'”’)\]]*)\s+|[।॥。！？…][\"'”’)\]]*\s*")),
    (LINE, regex.compile(r"[^\S\n]*\n\s*")),
    (PARAGRAPH, regex.compile(r"[^\S\n]*\n[^\S\n]*\n\s*")),
)
_TORN = regex.compile(r"[\p{M}‍]|(?<=‍).")


def sections(text: str) -> Iterator[tuple[int, list[str], str]]:
    """(number, trail of headings, body) of every section, the empty ones too; line ends are already line feeds."""
    trail: list[str] = []
    start = 0
    marks = [*_HEADING.finditer(text), None]
    for n, mark in enumerate(marks):
        yield n, list(trail), text[start : mark.start() if mark else len(text)].strip()
        if mark:
            trail = [*trail[: len(mark[1]) - 1], mark[2].strip()]
            start = mark.end()


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character, and at the end."""
    out = np.full(len(text) + 1, BARE, np.int64)
    for m in _TORN.finditer(text):
        out[m.start()] = 0
    for strength, pattern in _PLACES:
        out[[m.end() for m in pattern.finditer(text)]] = strength
    return out


class StrongestCut:
    """Sparse table: level j holds the best key of every window of 2**j places; keys order by strength, then place."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.levels = [strength << 40 | np.arange(len(strength))]
        while 2 << (len(self.levels) - 1) <= min(widest, len(strength)):
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(self.levels[-1][:-half], self.levels[-1][half:]))

    def query(self, first: int, last: int) -> int:
        """The strongest place from first to last, both included; the rightmost of equals."""
        j = (last - first + 1).bit_length() - 1
        best = max(int(self.levels[j][first]), int(self.levels[j][last - (1 << j) + 1]))
        return best & ((1 << 40) - 1)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text, each after the first starting before the end of the one before it."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    index = StrongestCut(strengths(text), limit)
    out, start = [], 0
    while len(text) - start > limit:
        least = start + max(int(limit * LEAST_SHARE), overlap + 1)
        end = index.query(least, start + limit)
        out.append((start, end))
        start = index.query(end - overlap, end - max(1, overlap // 2)) if overlap else end
    out.append((start, len(text)))
    return out


_PIECE = "section_no int, heading_trail array<string>, chunk_index int, piece_no int, n_pieces int, start int, overlap int, piece string"


def split_texts(df: DataFrame, keep: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The columns ``keep`` and, for every piece of every section of ``text`` in order: section_no, heading_trail,
    chunk_index (over the whole text, from 0), piece_no and n_pieces (of the section), start (in the section), overlap
    (characters repeated) and the piece."""
    if not 0 <= overlap < limit * LEAST_SHARE:
        raise ValueError("the overlap must be less than half the limit")
    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(_PIECE)])
    arrow = pa.schema([("section_no", pa.int32()), ("heading_trail", pa.list_(pa.string())), *((c, pa.int32()) for c in ("chunk_index", "piece_no", "n_pieces", "start", "overlap")), ("piece", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # pieces of few texts at once lie in memory
                part = batch.slice(at, 256)
                rows, of = [], []
                for row, value in enumerate(part.column(len(keep)).to_pylist()):
                    index = 0
                    for n, trail, body in sections((value or "").replace("\r\n", "\n")):
                        pieces = cut(body, limit, overlap)
                        for k, (a, b) in enumerate(pieces):
                            rows.append((n, trail, index, k, len(pieces), a, pieces[k - 1][1] - a if k else 0, body[a:b]))
                            index += 1
                        of.extend([row] * len(pieces))
                columns = zip(*rows) if rows else [[]] * len(arrow)
                kept = [part.column(i).take(pa.array(of, pa.int32())) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(columns, arrow))], names=[f.name for f in schema])

    return spread(df.select(*keep, text)).mapInArrow(split, schema)
