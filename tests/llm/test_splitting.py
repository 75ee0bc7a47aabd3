"""Pieces join to their sections, are short enough, overlap, and end at the strongest cut of their window."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from passagemill.llm import splitting as S

ALPHABET = "ab é.,;\nिक।#!? "


def brute_cut(text, limit, overlap):
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    strength, out, start = S.strengths(text), [], 0
    best = lambda a, b: max(range(a, b + 1), key=lambda i: (strength[i], i))
    while len(text) - start > limit:
        end = best(start + max(limit // 2, overlap + 1), start + limit)
        out.append((start, end))
        start = best(end - overlap, end - max(1, overlap // 2)) if overlap else end
    return [*out, (start, len(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.sampled_from([(20, 4), (21, 0), (50, 20), (7, 1)]))
def test_same_as_brute_force(text, sizes):
    limit, overlap = sizes
    text = text.strip()
    pieces = S.cut(text, limit, overlap)
    assert pieces == brute_cut(text, limit, overlap)
    assert "".join(text[a if not k else pieces[k - 1][1] : b] for k, (a, b) in enumerate(pieces)) == text
    assert all(0 < b - a <= limit for a, b in pieces)
    assert all((0 < e - s <= overlap) if overlap else e == s for (_, e), (s, _) in zip(pieces, pieces[1:]))


def test_sections_follow_headings():
    text = "zero\n# A\none\n### C\n\n##not\n####### seven\n## B\nlast"
    assert [(n, t, b) for n, t, b in S.sections(text)] == [
        (0, [], "zero"), (1, ["A"], "one"), (2, ["A", "C"], "##not\n####### seven"), (3, ["A", "B"], "last")
    ]


def test_prefers_strong_places_and_spares_marks():
    text = "x" * 700 + "\n\n" + "y " * 500
    assert S.cut(text)[0] == (0, 702)
    text = ("कि" * 2000).strip()
    assert all(text[a] != "ि" for a, _ in S.cut(text))


def test_operator(spark):
    rng = random.Random(1)
    long = " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(900))
    rows = [(1, None, "clash"), (2, "", "clash"), (3, " \r\n ", None), (4, "# H\r\n" + "a" * 1200, None), (5, "# H\r\n" + "a" * 600 + "\r\n" + "b" * 600, None), (6, long, None), (6, long, None)]
    got = S.split_texts(spark.createDataFrame(rows, "raw_id long, text string, piece string"), ["raw_id"]).collect()
    assert {(r.raw_id, r.section_no) for r in got if r.n_pieces > 1} == {(5, 1), (6, 0)}
    assert [r.chunk_index for r in got if r.raw_id == 6][: got[-1].n_pieces] == list(range(got[-1].n_pieces))
    assert sum(r.raw_id == 6 for r in got) == 2 * got[-1].n_pieces
    assert all(len(r.piece) <= 1200 for r in got)
    assert not {1, 2, 3} & {r.raw_id for r in got}
    assert S.split_texts(spark.createDataFrame([], "raw_id long, text string"), ["raw_id"]).count() == 0


def test_overlap_must_leave_progress(spark):
    with pytest.raises(ValueError):
        S.split_texts(spark.createDataFrame([(1, "x")], "raw_id long, text string"), ["raw_id"], overlap=700)
