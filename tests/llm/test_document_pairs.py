"""Similar documents are found whether or not they are neighbours by id, of one source or of any."""

from passagemill.llm.queries import QUERIES


def test_pairs_that_are_no_neighbours(spark, tmp_path):
    said = "the exit load of this fund is one percent within a year and nothing after it so units may be held or sold as the holder likes"
    docs = [(1, "a", said), (2, "a", "units are locked for three years"), (3, "a", "a lump sum starts at five thousand"), (4, "a", f"{said} indeed"), (5, None, said.upper()), (6, "b", None)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, QUERIES["doc_near_pairs"](spark, str(tmp_path)).collect())) == [(1, 4), (1, 5), (4, 5)]
