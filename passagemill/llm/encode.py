"""Token ids and token counts of a text column under a public vocabulary.

Each text is split into words; the distinct words of a slice of texts that a worker has not met yet go through the
vectorised encoder (or counting automaton) together. Nothing is shuffled: texts are read, encoded and written in the
tasks of the scan.

Defined results: an empty and a null text give the empty list and 0 tokens; strings that look like special tokens are
ordinary text; repeated rows give repeated results; other columns do not take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from passagemill.llm import bpe
from passagemill.session import spread

#: Code points of text that a worker splits at once, and words that it remembers. Both bound memory, not results.
SLICE_CHARS = 1_500_000
REMEMBERED = 400_000


class WordTable:
    """What a worker knows about the words it met: ids of each (or only their number)."""

    def __init__(self, vocabulary: bpe.Vocabulary, count_only: bool):
        self.vocabulary, self.count_only = vocabulary, count_only
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word in ``offsets``."""
        if len(self.index) > REMEMBERED:
            self.clear()
        new = sorted(set(words).difference(self.index))
        if new:
            raw = [w.encode("utf-8", "surrogatepass") for w in new]
            if self.count_only:
                more = np.cumsum(self.vocabulary.count(raw))
            else:
                ids, offsets = self.vocabulary.encode(raw)
                self.ids, more = np.concatenate([self.ids, ids]), offsets[1:]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.offsets = np.concatenate([self.offsets, more + self.offsets[-1]])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


_TABLES: dict[tuple[str, str, bool], WordTable] = {}


def _table(key: tuple[str, str, bool], broadcast) -> WordTable:
    if key not in _TABLES:
        _TABLES[key] = WordTable(broadcast.value, key[2])
    return _TABLES[key]


def slices(texts: list[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``most`` code points; a longer text is a range of its own."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if chars + n > most and i > start:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def _tokens(table: WordTable, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of all texts in order, and the offset of each text among them."""
    split = [bpe.split_words(t) if t else [] for t in texts]
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))]
    return table.rows([w for words in split for w in words]), offsets


def _run(df: DataFrame, keep: list[str], text: str, out: T.StructField, vocabulary: str, folder: str) -> DataFrame:
    count_only = not isinstance(out.dataType, T.ArrayType)
    key = (vocabulary, folder, count_only)
    shared = df.sparkSession.sparkContext.broadcast(bpe.load(vocabulary, folder))
    schema = T.StructType([*(df.schema[c] for c in keep), out])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(key, shared)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in slices(texts):
                rows, offsets = _tokens(table, texts[a:b])
                lengths = table.offsets[rows + 1] - table.offsets[rows]
                ends = np.r_[0, np.cumsum(lengths)]
                of_text = ends[offsets]
                if count_only:
                    result = pa.array(np.diff(of_text))
                else:
                    at = np.repeat(table.offsets[rows] - ends[:-1], lengths) + np.arange(ends[-1])
                    result = pa.ListArray.from_arrays(pa.array(of_text.astype(np.int32)), pa.array(table.ids[at]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), result], names=[f.name for f in schema])

    return spread(df.select(*keep, text)).mapInArrow(encode, schema)


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", out: str = "ids", vocabulary: str = bpe.BYTE_BPE_50K, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``out``, the ids of ``text`` without special tokens."""
    return _run(df, keep, text, T.StructField(out, T.ArrayType(T.IntegerType())), vocabulary, folder)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", vocabulary: str = bpe.BYTE_BPE_50K, folder: str = bpe.TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``out``, the number of ids that ``encode_texts`` would give."""
    return _run(df, keep, text, T.StructField(out, T.LongType()), vocabulary, folder)
