"""Continuous ingest: several pages of a source, repeated and late batches, broken-off replacements, any file system."""

import json

from passagemill import schemas
from passagemill.sources import files
from passagemill.streaming import ingest as I


def page(source, url, text, at):
    return {"source_id": source, "url": url, "text": text, "fetched_at": at}


def batch(spark, *pages):
    return spark.read.schema(schemas.RAW_DOC).json(spark.sparkContext.parallelize([json.dumps(p) for p in pages]))


def rows(spark, target):
    return {(r.source_id, r.url, r.text) for r in I.read_store(spark, target).collect()}


def test_pages_of_one_source(spark, tmp_path):
    target = (tmp_path / "store").as_uri()
    first = [page("s", "u/1", "the first page says one", "2026-01-01T00:00:00Z"), page("s", "u/2/", "the second page says two", "2026-01-01T00:00:00Z")]
    I.upsert_pages(spark, batch(spark, *first), target)
    want = {("s", p["url"], p["text"]) for p in first}
    assert rows(spark, target) == want
    I.upsert_pages(spark, batch(spark, *first), target)  # delivered again
    assert rows(spark, target) == want
    other = page("t", "u/1", "another source says three", None)
    I.upsert_pages(spark, batch(spark, other), target)
    assert rows(spark, target) == want | {("t", "u/1", other["text"])}
    ids = [r.chunk_id for r in spark.read.parquet(target).collect()]
    assert len(ids) == len(set(ids)) == 3


def test_the_latest_version_wins(spark, tmp_path):
    target = str(tmp_path / "store")
    v = [page("s", "u", f"version {n} of the page", f"2026-01-0{n}T00:00:00+05:30") for n in (1, 2, 3)]
    I.upsert_pages(spark, batch(spark, v[1], v[0]), target)
    assert rows(spark, target) == {("s", "u", v[1]["text"])}
    I.upsert_pages(spark, batch(spark, v[0]), target)  # late
    assert rows(spark, target) == {("s", "u", v[1]["text"])}
    I.upsert_pages(spark, batch(spark, v[2] | {"url": "u/"}), target)
    assert rows(spark, target) == {("s", "u/", v[2]["text"])}
    I.upsert_pages(spark, batch(spark, page("s", "u", None, "2026-02-01T00:00:00Z")), target)
    assert rows(spark, target) == set()


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    target = tmp_path / "store"
    I.upsert_pages(spark, batch(spark, *(page(f"s{i}", "u", f"page number {i} here", None) for i in range(40))), str(target))
    before = {f.name: f.stat().st_mtime_ns for f in target.iterdir()}
    I.upsert_pages(spark, batch(spark, page("s7", "u", "page number seven anew", None)), str(target))
    assert sum(f.stat().st_mtime_ns != before[f.name] for f in target.iterdir() if f.name in before) <= 1
    assert len(rows(spark, str(target))) == 40 and ("s7", "u", "page number seven anew") in rows(spark, str(target))


def test_a_replacement_that_broke_off_is_undone(spark, tmp_path):
    target = tmp_path / "store"
    I.upsert_pages(spark, batch(spark, page("s", "u", "what was there before", None)), str(target))
    folder = next(f for f in target.iterdir() if f.name.startswith("bucket="))
    (tmp_path / "store._old").mkdir()
    folder.rename(tmp_path / "store._old" / folder.name)
    I.upsert_pages(spark, batch(spark, page("t", "u", "what comes after it", None)), str(target))
    assert {t for *_, t in rows(spark, str(target))} == {"what was there before", "what comes after it"}


def test_damaged_vectors_are_none(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "part.parquet").write_bytes(b"not parquet at all")
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == 0
    assert files.status(spark, {"a": (tmp_path / "none").as_uri()}) == {"a": None}
