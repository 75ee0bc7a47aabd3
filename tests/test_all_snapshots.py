"""Store, orphans and cache over every snapshot, whatever the numbers of the snapshots are."""

import pytest

from passagemill.plans.catalogue import QUERIES

STATES = {2: {"a": "one", "b": "two", "c": "three"}, 5: {"a": "one", "b": "new", "d": "three"}, 6: {"b": "two", "d": "last", "e": None}, 9: {"a": "one", "d": "fresh", "f": "fresh"}}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(no, k, "s", 0, t, "2026-01-02T00:00:00Z") for no, texts in STATES.items() for k, t in texts.items()]
    rows += [(5, "b", "s", 0, "older", "2026-01-01T00:00:00Z"), rows[0]]
    path = tmp_path_factory.mktemp("snapshots")
    spark.createDataFrame(rows, "snapshot_no int, chunk_id string, source_id string, chunk_index int, text string, fetched_at string").write.parquet(f"{path}/chunk.parquet")
    return str(path)


def test_store_is_folded_over_all(spark, folder):
    import hashlib

    want = {k: t and hashlib.sha256(t.encode()).hexdigest() for texts in STATES.values() for k, t in texts.items()}
    got = QUERIES["chunk_upsert_all"](spark, folder).collect()
    assert len(got) == len(want) and {r.chunk_id: r.content for r in got} == want


def test_orphans_of_each_snapshot(spark, folder):
    numbers = sorted(STATES)
    want = sorted((b, k) for a, b in zip(numbers, numbers[1:]) for k in STATES[a].keys() - STATES[b].keys())
    assert sorted((r.snapshot_no, r.chunk_id) for r in QUERIES["chunk_orphans_all"](spark, folder).collect()) == want


def test_cache_of_all_earlier_snapshots(spark, folder):
    want, cache = [], set(STATES[2].values())
    for no in (5, 6, 9):
        texts = [t for t in STATES[no].values() if t is not None]
        want.append((no, len(texts), sum(t in cache for t in texts), len({*texts} - cache)))
        cache |= {*texts}
    assert sorted((r.snapshot_no, r.total, r.hits, r.misses) for r in QUERIES["chunk_cache_all"](spark, folder).collect()) == want
