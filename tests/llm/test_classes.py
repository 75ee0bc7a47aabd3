"""Every current passage has one row in p5_classes, with or without words."""

from passagemill.llm.queries import QUERIES


def test_passages_without_words_have_a_row(spark, tmp_path):
    texts = {"a": "The exit load is one percent.", "b": "the EXIT load is one percent", "c": "Units are locked for three years.", "null": None, "empty": "", "signs": "-- !? --"}
    rows = [(no, k, t, "2026-01-02T00:00:00Z") for no in (1, 2) for k, t in texts.items()] + [(1, "gone", "", "2026-01-02T00:00:00Z"), (2, "empty", "older words", "2026-01-01T00:00:00Z")]
    spark.createDataFrame(rows, "snapshot_no int, chunk_id string, text string, fetched_at string").write.parquet(f"{tmp_path}/chunk.parquet")
    got = {r.chunk_id: r for r in QUERIES["p5_classes"](spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    assert len({r.class_id for r in got.values()}) == 5 and got["a"].class_id == got["b"].class_id
    assert all((got[k].n_copies, got[k].n_links) == (1, 0) for k in ("null", "empty", "signs")) and got["a"].n_copies == 2
