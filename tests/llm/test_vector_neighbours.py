"""Nearest vectors against brute force."""

import numpy as np
import pytest

from passagemill.llm import vector_neighbours as V

SCHEMA = "chunk_id string, embedding array<float>, score string, id string"


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i, a in enumerate(ids):
        # equal vectors give equal scores but for rounding; ids decide
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))
        out |= {(a, ids[j]) for j in order[:k] if s[i, j] >= least}
    return out


def made(seed, n, d):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    out = {}
    while len(out) < n:
        base = centres[rng.integers(8)] * 0.8 + rng.normal(size=d)
        for _ in range(rng.integers(1, 7)):
            out[f"{rng.integers(10**9):09d}"] = ((base + rng.normal(size=d) * rng.uniform(0.1, 0.5)) * rng.uniform(0.5, 3)).astype(np.float32)
    return out


def test_same_as_brute_force(spark):
    vectors = made(1, 1500, 384)
    hot = next(iter(vectors.values()))
    vectors |= {f"copy{i:02d}": hot for i in range(30)}
    rows = [(i, v.tolist(), None, "clash") for i, v in vectors.items()]
    rows += rows[:5] + [("null", None, None, None), ("short", [1.0], None, None), ("zero", [0.0] * 384, None, None), ("nan", [float("nan")] + [1.0] * 383, None, None), ("inf", [float("inf")] * 384, None, None), ("hole", [None] + [1.0] * 383, None, None)]
    got = V.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5), "chunk_id", "embedding").collect()
    assert len(got) == len({(r.chunk_id, r.neighbour) for r in got})
    want = brute(vectors, 5, 0.8)
    assert len({(r.chunk_id, r.neighbour) for r in got} & want) >= 0.99 * len(want)
    assert {(r.chunk_id, r.neighbour) for r in got} <= want or len({(r.chunk_id, r.neighbour) for r in got} - want) <= 0.01 * len(want)
    copies = {(r.chunk_id, r.neighbour) for r in got if r.chunk_id.startswith("copy")}
    assert copies == {x for x in want if x[0].startswith("copy")}
    for r in got:
        assert 0.8 <= r.score <= 1 + 1e-9 and 1 <= r["rank"] <= 5


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, n):
    rows = [(f"v{i}", [1.0] * 384, None, None) for i in range(n)]
    assert V.neighbours(spark.createDataFrame(rows, SCHEMA), "chunk_id", "embedding").count() == (2 if n == 2 else 0)


# places of more than 15 rows are divided in the second case
@pytest.mark.parametrize("full", [20_000, 15])
def test_pigeonhole_pairs_come_out_once(spark, full):
    width, per_word, parts = 6, 10, 38
    rng = np.random.default_rng(3)
    code = rng.integers(0, 2, (300, width * parts))
    for i in range(0, 300, 2):  # pairs within the distance that must be found: some part stays as it is
        code[i + 1] = code[i]
        flips = rng.choice(width * parts, rng.integers(0, parts), replace=False)
        code[i + 1, flips] ^= 1
    bits = np.zeros((300, V.WORDS, 64), bool)
    bits[:, :, : width * per_word] = np.pad(code, ((0, 0), (0, V.WORDS * per_word * width - code.shape[1]))).reshape(300, V.WORDS, -1)
    words = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    codes = spark.createDataFrame([(i, bytearray(w.tobytes())) for i, w in enumerate(words)], "id long, code binary").repartition(3)
    most = (parts - 1, parts - 1)
    plan = V.Plan(width, per_word, parts, np.zeros(1), np.zeros((1, V.WORDS * per_word * width), np.float32), most, 1.0)
    got = [tuple(r) for r in V._near_pairs(codes, plan, 300, full).collect()]
    assert len(got) == len(set(got))
    first = code[:, : width * per_word]
    near = lambda i, j: (code[i] != code[j]).sum() < parts and (first[i] != first[j]).sum() < parts
    assert set(got) == {(i, j) for i in range(300) for j in range(i + 1, 300) if near(i, j)}


@pytest.mark.parametrize("n", [60_000, 1_000_000, 30_000_000])
def test_recall_at_the_floor_holds_for_any_number(n):
    vectors = V.unit(np.random.default_rng(6).permutation(np.array(list(made(5, 9000, 384).values()))))
    learned, unseen = vectors[:7000], vectors[7000:]
    plan = V.make_plan(learned, n)
    assert plan.recall >= V.RECALL
    for a, b in V.at_floor(unseen, V.MIN_SCORE, 3000, 1):
        assert np.allclose((a * b).sum(1), V.MIN_SCORE) and V.meeting(plan, a, b).mean() >= 0.94


def test_repeated_ids_count_with_the_greatest_vector(spark):
    x = [[0.0] * 383 + [1.0], [1.0] + [0.0] * 383, [0.9] + [0.1] + [0.0] * 382]
    rows = [("a", x[0], None, None), ("a", x[1], None, None), ("b", x[2], None, None), ("b", x[2], None, None), ("c", x[0], None, None)]
    got = V.neighbours(spark.createDataFrame(rows, SCHEMA), "chunk_id", "embedding").collect()
    assert {(r.chunk_id, r.neighbour) for r in got} == {("a", "b"), ("b", "a")}
