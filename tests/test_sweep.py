"""The sweep of chunking settings against one cell at a time, by the operators of the pipeline."""

from pyspark.sql import functions as F

from passagemill.operators import evaluate as E, segmentation as S, sweep as W, vectors as V

FACTS = ["The exit load of {} is {} percent.", "A lump sum in {} starts at {} rupees.", "Units of {} are locked for {} weeks."]


def tables(spark):
    names = ["Kraven Growth", "Montis Liquid", "Boufel Index"]
    body = lambda n, i: "\n".join(f"## Part {k}\n" + " ".join(FACTS[k].format(n, 10 * i + k) + f" More of part {k} is told in note {m}." * 3 for m in range(9)) for k in range(3))
    docs = [(f"s{i}#{i}", f"s{i}", n, f"{n} page", body(n, i)) for i, n in enumerate(names)] + [("s9#9", "s9", "Long", None, "word " * 900)]
    gold = [(f"g{i}{k}", FACTS[k].format(n, ""), f"s{i}", FACTS[k].format(n, 10 * i + k)) for i, n in enumerate(names) for k in range(3)] + [("none", "Who knows?", "s0", "not there")]
    return spark.createDataFrame(docs, "source_id string, page_source string, scheme_name string, page_title string, text string"), spark.createDataFrame(gold, "id string, question string, expected_source_id string, answer_span string")


def alone(spark, docs, gold, name, size, chars):
    """One cell by passages, enforce_budget, embed, nearest and first_hits."""
    chunks, report = S.enforce_budget(S.passages(docs, name, size, chars))
    vectors = V.embed(chunks, spark.createDataFrame([], "key string, embedding array<float>"))[0]
    asked = gold.select(F.col("id").alias("query_id"), V.encode("question").alias("vector"))
    near = V.nearest(vectors.select(F.col("chunk_id").alias("row_id"), F.col("embedding").alias("vector")), asked, 5)
    ranked = near.join(chunks.select(F.col("chunk_id").alias("row_id"), "text", F.col("page_source").alias("source_id")), "row_id").withColumnRenamed("query_id", "question_id")
    s, r = E.summary(chunks).first(), report.first()
    return s.n_chunks, round(E.scores(E.first_hits(gold, ranked)).first().hit_at_5, 4), s.mean_chars, s.max_tokens, r.violations, r.rescued


def test_every_cell_is_there_and_as_alone(spark):
    docs, gold = tables(spark)
    rows = W.sweep(docs, gold).orderBy("cell_no").collect()
    assert [(r.strategy, r.size, r.overlap) for r in rows] == [(s, n, o) for s in W.STRATEGIES for n in W.SIZES for o in W.OVERLAPS] and len(rows) == 45
    for r in (rows[1], rows[18], rows[29], rows[32], rows[44]):
        assert (r.n_chunks, r.recall_at_5, r.mean_chars, r.max_tokens, r.violations, r.rescued) == alone(spark, docs, gold, r.strategy, r.size, r.overlap_chars)
    assert len({r.recall_at_5 for r in rows}) > 1 and max(r.rescued for r in rows) > 0


def test_cells_that_stand_for_others_split_alike():
    text = "\n\n".join(" ".join(f"Sentence {i} of part {k} says word {i * k}." for i in range(60)) for k in range(4))
    for _, name, size, _, chars in W.grid():
        stand_in, n, o = S.alike(name, size, chars)
        assert S.STRATEGIES[name](size, chars)(text) == S.STRATEGIES[stand_in](n, o)(text)


def test_cells_without_passages_are_skipped(spark):
    docs, gold = tables(spark)
    rows = W.sweep(docs.where("false"), gold).collect()
    assert len(rows) == 45 and all(r.skipped and r.n_chunks == 0 and r.recall_at_5 == 0 for r in rows)
    assert E.grid_winner(W.sweep(docs.where("false"), gold)).count() == 0
