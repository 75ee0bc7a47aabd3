"""Changes between snapshots, against a dictionary version of the same rule."""

import random

import numpy as np
import pytest

from passagemill.operators import snapshots as S

STATES = "table_name string, snapshot_no int, record_key string, state string"


def brute(rows):
    by = {}
    for t, n, k, s in rows:
        by.setdefault((t, n), {})[k] = s
    out = set()
    for t in {t for t, _ in by}:
        nos = sorted(n for x, n in by if x == t)
        for a, b in zip(nos, nos[1:]):
            old, new = by[t, a], by[t, b]
            for k in old.keys() | new.keys():
                if k not in old:
                    out.add((t, b, k, "added"))
                elif k not in new:
                    out.add((t, b, k, "removed"))
                elif old[k] != new[k]:
                    out.add((t, b, k, "changed"))
    return out


def made(seed, n=300, tables=("a", "b"), numbers=(1, 2, 5, 6)):
    rng = random.Random(seed)
    return [(t, s, f"k{i}", f"v{rng.randint(0, 2)}") for t in tables for s in numbers for i in range(n) if rng.random() < 0.8]


# few cells make every bucket fail in one or in both rounds, so that the larger tables and the full comparison are used
@pytest.mark.parametrize("cells, per_bucket", [(160, 1024), (16, 256), (2, 512), (1, 4096)])
def test_same_as_dictionaries(spark, cells, per_bucket):
    rows = made(cells)
    got = S.snapshot_changes(spark.createDataFrame(rows, STATES), cells, per_bucket).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows)


def test_one_failing_bucket_leaves_its_neighbours_alone(spark):
    # all keys change from 1 to 2, hardly any from 2 to 3: only the first pair needs the larger tables
    rows = [("t", n, f"k{i}", f"{n > 1}" if i else f"{n}") for n in (1, 2, 3) for i in range(400)]
    got = S.snapshot_changes(spark.createDataFrame(rows, STATES), 16, 512).collect()
    assert {tuple(r) for r in got} == brute(rows)


def test_empty_and_single_snapshots(spark):
    assert S.snapshot_changes(spark.createDataFrame([], STATES)).count() == 0
    assert S.snapshot_changes(spark.createDataFrame([("t", 3, "k", "v")], STATES)).count() == 0


def test_hash_is_that_of_spark(spark):
    x = np.array([0, 1, -1, 2**62, -(2**63), 123456789], np.int64)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, x[::-1])], "a long, b long")
    assert [r[0] for r in df.selectExpr("xxhash64(a, b)").collect()] == S.xxhash64_longs(x, x[::-1]).tolist()


def test_current_rows_and_stand_in_states(spark):
    schema = "raw_id long, snapshot_no int, url string, text string, fetched_at string, http_status int, content_hash string, state string, at string"
    rows = [
        (1, 1, "https://x.example/a/", "one", "2026-01-01T10:00:00Z", 200, "AB", "clash", "clash"),
        (2, 1, "https://x.example/a", "two", "2026-01-01T14:00:00+05:30", 200, "CD", None, None),  # 08:30, earlier
        (3, 2, "https://x.example/a", "one", None, 200, "ab", None, None),
        (4, 2, "https://x.example/b", "text", "2026-02-01T10:00:00.500Z", 200, None, None, None),
        (5, 3, "https://x.example/b", "text", "2026-03-01T10:00:00Z", 200, "982D9E3EB996F559E633F4D194DEF3761D909F5A3B647D1A851FEAD67C32C9D1", None, None),
        (6, 3, "https://x.example/c", None, "2026-03-01T10:00:00Z", 503, None, None, None),
        (7, 3, None, "x", "not a time", 200, None, None, None),
    ]
    got = S.snapshot_changes(S.page_states(spark.createDataFrame(rows, schema))).collect()
    assert {tuple(r)[1:] for r in got} == {(2, "https://x.example/b", "added"), (3, "https://x.example/a", "removed")}
