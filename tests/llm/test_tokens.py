"""Encoding, counting and packing against the tokenizer's own library, and against simple versions of the rules."""

import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from passagemill.llm import bpe, encode, packing, token_budget

TEXTS = ["", None, " ", "<|endoftext|> x", "don't  stop\r\n\n", "नमस्ते दुनिया", "a" * 3000, "😀👩‍👩‍👧 ​", "1,234.50% " * 50, "\x00\x1f", "Ünïcödé"]


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(f"{bpe.TOKENIZERS}/{bpe.BYTE_BPE_50K}"))}
    return tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=ranks, special_tokens={})


def test_vocabulary_against_library(reference):
    rng = random.Random(2)
    words = ["".join(rng.choices("ab AB01éक्😀<|>-=", k=rng.randint(0, 25))) for _ in range(3000)] + [c * k for c in "a= -0" for k in (1, 2, 3, 5, 17, 64, 200)]
    raw = [w.encode() for w in words]
    v = bpe.load()
    ids, at = v.encode(raw)
    want = [reference._core_bpe.encode_single_piece(w) if w else [] for w in raw]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert v.count(raw).tolist() == [len(w) for w in want]


def test_other_vocabulary_of_the_same_kind():
    tokens = bpe.read_ranks(f"{bpe.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("o", pat_str=bpe.WORDS, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    v, words = bpe.load("byte_bpe_multi_50k.tiktoken"), [" Größenordnung", "निवेशक", "xyzzyqqq", " 402"]
    assert v.count([w.encode() for w in words]).tolist() == [len(other.encode_ordinary(w)) for w in words]


def test_operators_against_library(spark, reference):
    rows = [(i, t, "clash", None) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    for part in (df, df.coalesce(1), df.repartition(20)):
        got = encode.encode_texts(part, ["doc_id"]).collect()
        assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, reference.encode_ordinary(t or "")) for i, t, *_ in rows)
        got = encode.count_tokens(part, ["doc_id"]).collect()
        assert sorted(map(tuple, got)) == sorted((i, len(reference.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert encode.encode_texts(df.limit(0), ["doc_id"]).count() == 0


def test_remembered_words_may_be_forgotten(spark, monkeypatch):
    monkeypatch.setattr(encode, "REMEMBERED", 3)
    t = encode.WordTable(bpe.load(), False)
    words = [f" w{i}" for i in range(50)]
    for k in range(0, 50, 5):
        rows = t.rows(words[k : k + 5])
        assert all(t.offsets[r + 1] > t.offsets[r] for r in rows)


def test_budget_counts_spellings_together(spark):
    docs = [(1, "one two", "en", "A b", None, "2026"), (2, "one", "EN", " a  B ", "faq", "x"), (3, None, "en-IN", "a b", "FAQ", None), (4, "x", "und", None, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, domain string, level string")
    got = {(r.source, r.lang, r.domain, r.level): (r.n_texts, r.n_tokens) for r in token_budget.document_budget(df).collect()}
    assert got["a b", "en", None, 1] == (3, 3)
    assert got["a b", "en", "faq", 0] == (2, 1)
    assert got["unknown", "unknown", "unknown", 0] == (1, 1)
    assert got[None, None, None, 7] == (4, 4)


def test_budget_of_current_passages(spark):
    rows = [(1, "a", "old old old", "s", "N", "en", "2026-01-01T00:00:00Z"), (2, "a", "one two", "s", "Name", "en", "2026-02-01T10:00:00+05:30"), (2, "a", "one", "s", "NAME", "EN", "2026-02-01T06:00:00Z"), (2, "b", None, "s", None, None, None)]
    df = spark.createDataFrame(rows, "snapshot_no int, chunk_id string, text string, source_id string, scheme_name string, lang string, fetched_at string")
    got = {(r.source_id, r.scheme_name, r.lang, r.level): (r.n_texts, r.n_tokens) for r in token_budget.passage_budget(df).collect()}
    assert got["s", "name", "en", 0] == (1, 1)
    assert got[None, None, None, 7] == (2, 1)


@pytest.mark.parametrize("seed", range(6))
def test_packing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(4, 1.2, 3000).astype(np.int64) + 1, 512)
    container, n = packing.pack(lengths, 512)
    room = np.bincount(container, lengths, minlength=n)
    assert len(room) == n and 0 < room.min() and room.max() <= 512
    # as good as placing the longest item that fits, one at a time
    left, opened = np.bincount(lengths, minlength=513), 0
    while left.any():
        space, opened = 512, opened + 1
        while (fit := np.flatnonzero(left[: space + 1])).size:
            left[fit[-1]] -= 1
            space -= fit[-1]
    assert n == opened


def test_packing_operator(spark):
    rows = [(1, 0), (2, None), (3, 10), (4, 25), (4, 25), (5, 30), (6, 7), (7, 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("piece_no", F.lit("clash"))
    got = packing.pack_items(df, capacity=10, shard=3).collect()
    assert {r.doc_id for r in got if r.container_id is None} == {1, 2}
    assert all(r.n_tokens == 0 for r in got if r.container_id is None)
    fill = {}
    for r in got:
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 10 and sum(fill.values()) == 100
    assert sorted(r.n_tokens for r in got if r.doc_id == 5) == [10, 10, 10]
    assert sorted((r.piece_no, r.token_start) for r in got if r.doc_id == 4) == [(0, 0), (0, 0), (1, 10), (1, 10), (2, 20), (2, 20)]
    assert packing.pack_items(df.limit(0)).count() == 0


def test_containers_take_a_fixed_count_of_their_class():
    rng = np.random.default_rng(4)
    lengths = np.r_[rng.integers(1, 513, 3000), np.full(500, 171), np.full(300, 256)]
    container, n = packing.pack(lengths, 512)
    fewer: dict[int, int] = {}
    for c in range(n):
        own = lengths[container == c]
        k = 512 // own.max()
        fewer[k] = fewer.get(k, 0) + ((512 // own == k).sum() != k)
    assert max(fewer.values()) <= 1  # the last container of a class


def test_packing_does_not_depend_on_the_division(spark):
    rows = [(i % 700, i % 90, "extra") for i in range(2000)] + [(5, 30, None)] * 400 + [(None, 12, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, _n string")
    one, other = ({tuple(r): 0 for r in packing.pack_items(d, capacity=64, shard=300).collect()} for d in (df.repartition(1), df.orderBy(F.rand(3)).repartition(7)))
    assert one == other
    assert packing.audit(df, packing.pack_items(df, capacity=64, shard=300), capacity=64).first().asDict() == {"n_items": len(rows), "n_wrong_tokens": 0, "n_cut_in_vain": 0, "n_overfull": 0}
