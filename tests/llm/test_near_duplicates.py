"""The similarity join against comparison of all pairs."""

import random

import numpy as np
import pytest
import regex

from passagemill.llm import near_duplicates as N
from passagemill.llm.runs import pairs_within


def brute(texts, threshold=0.8):
    sets = [(i, {w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w}) for i, t in texts]
    return {
        tuple(sorted((i, j)))
        for k, (i, a) in enumerate(sets)
        for j, b in sets[:k]
        if a and b and i != j and len(a & b) >= threshold * len(a | b)
    }


def made(rng, n, copies):
    vocabulary = [f"w{i}" for i in range(400)] + ["क्या", "Éa", "x́"]
    out = []
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.randint(1, 60))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rng.shuffle(text)
            out.append((f"{rng.randrange(10**9):09d}", rng.choice([" ", ", ", "\n"]).join(text)))
    return out


@pytest.mark.parametrize("bucket", [4096, 40])
def test_same_as_all_pairs(spark, bucket):
    rng = random.Random(3)
    texts = made(rng, 500, 5) + [("n", None), ("e", ""), ("s", " -- "), ("one", "a"), ("two", "A!"), ("rep", "p q"), ("rep", "p q")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "id string, text string, words string")
    links, members = N.near_duplicates(df, "id", bucket=bucket)
    got = {tuple(r) for r in N.near_duplicate_pairs(links, members, "id").collect()}
    assert got == brute(dict(texts).items())
    classes = N.near_duplicate_classes(links, members, "id").collect()
    assert len(classes) == len({i for i, t in texts} - {"n", "e", "s"})


def test_many_texts_that_share_most_words(spark):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(20)]
    texts = [(f"{i:04d}", " ".join(common + [f"r{rng.randrange(50)}" for _ in range(8)])) for i in range(300)]
    df = spark.createDataFrame(texts, "id string, text string")
    links, members = N.near_duplicates(df, "id", bucket=30)
    assert {tuple(r) for r in N.near_duplicate_pairs(links, members, "id").collect()} == brute(texts)


def test_texts_that_are_all_near_each_other(spark):
    common = [f"c{i}" for i in range(60)]
    texts = [(f"{i:04d}", " ".join([*common, f"own{i}", f"own{i // 2}x"])) for i in range(400)]
    links, members = N.near_duplicates(spark.createDataFrame(texts, "id string, text string"), "id", bucket=50)
    assert N.near_duplicate_pairs(links, members, "id").count() == 400 * 399 // 2


def test_hot_copies_and_empty_table(spark):
    texts = [(f"{i:03d}", "same words here" if i % 3 == 0 else f"other {i} text {i * 7} of {i * 13}") for i in range(150)]
    links, members = N.near_duplicates(spark.createDataFrame(texts, "id string, text string"), "id")
    assert links.count() == 0
    assert N.near_duplicate_pairs(links, members, "id").count() == 50 * 49 // 2
    links, members = N.near_duplicates(spark.createDataFrame([], "id string, text string"), "id")
    assert N.near_duplicate_pairs(links, members, "id").count() == 0


def test_runs_for_the_recall():
    assert N.runs_needed(3) <= N.RUNS < N.runs_needed(4) < N.runs_needed(8)


def test_pairs_within():
    key = np.array([1, 1, 1, 2, 3, 3, 9])
    want = {(0, 1), (0, 2), (1, 2), (4, 5)}
    for most in (1, 2, 100):
        assert {(int(a), int(b)) for i, j in pairs_within(key, most) for a, b in zip(i, j)} == want


def test_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "COPIES", 4)
    members = spark.createDataFrame([(7, f"c{i:02d}") for i in range(23)] + [(8, "x"), (8, "y"), (9, "z")], "rep long, id string")
    got = [tuple(r) for r in N._copies(members, "id").collect()]
    assert len(got) == len(set(got)) == 23 * 22 // 2 + 1 and all(a < b for a, b in got)
