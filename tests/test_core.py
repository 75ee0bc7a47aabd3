"""Operators of the core against plain Python versions and fixed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill import config
from passagemill.functions import text as X
from passagemill.operators import evaluate as E, extraction, guards as G, segmentation as S, store, validate, vectors as V
from passagemill.plans.fixtures import GRID, PAGES, REPLIES
from passagemill.sources import files


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("r")).first()[0]


# ---- text ----


@pytest.mark.parametrize(
    "text, want",
    [
        ("One is 1.03%. Two costs Rs. 100 now! Three?", ["One is 1.03%.", "Two costs Rs. 100 now!", "Three?"]),
        ('He said "go." Then left.', ['He said "go.', "Then left."]),
        ("Mr. Smith vs. Dr. Jones. End", ["Mr. Smith vs. Dr. Jones.", "End"]),
        ("no punctuation here", ["no punctuation here"]), ("", []), (None, []),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, X.sentences(F.col("x")), text) == want
    assert S._sentences(text or "") == want


def test_clean(spark):
    raw = "​Title   here\r\n\r\n\tline  two\r\nAll rights reserved 2020\n" + "x" * 250 + " cookie\n\n\n end "
    assert one(spark, X.clean(F.col("x")), raw) == "Title here\nline two\n" + "x" * 250 + " cookie\nend"
    assert one(spark, X.clean(F.col("x")), None) is None


def test_small_functions(spark):
    assert one(spark, X.word_count(F.col("x")), " a\t b\n\nc ") == 3
    assert [one(spark, X.word_count(F.col("x")), v) for v in (None, "", "  ")] == [0, 0, 0]
    assert one(spark, X.token_estimate(F.col("x")), "a b c d") == int(4 * 1.35) + 2
    assert one(spark, X.strip_tags(F.col("x")), "<p>a&amp;b</p>\n<b>c</b>&nbsp;d") == "a&b c d"
    assert one(spark, X.strip_markdown(F.col("x")), "```json\n**a**  b\n- c\n```") == "a b\nc"
    assert [one(spark, X.money(F.col("x")), v) for v in ("1500", "250.5", "0", "", None, "Nil")] == ["Rs 1,500", "Rs 250.50", None, None, None, "Nil"]
    assert [one(spark, X.yes_no(F.col("x")), v) for v in ("true", "No", "maybe", "", None)] == ["Yes", "No", "maybe", None, None]
    assert [one(spark, X.end_stop(F.col("x")), v) for v in (" a. ", "b")] == ["a.", "b."]
    assert one(spark, X.excerpt(F.col("x"), 5), "abc  def") == "abc …"
    assert one(spark, X.first_json_object(F.col("x")), 'so: {"a": "}{", "b": {"c": 1}} {') == '{"a": "}{", "b": {"c": 1}}'
    assert one(spark, X.first_json_object(F.col("x")), "{ none") is None
    assert one(spark, X.normalise_name(F.col("x")), " Large-Cap (Fund)! ") == "large cap fund"
    now = F.lit("2026-01-11").cast("timestamp")
    assert [one(spark, X.age_days(F.col("x"), now), v) for v in ("2026-01-01T00:00:00Z", "2026-01-01", "soon", None)] == [10, 10, None, None]


@pytest.mark.parametrize("a, b, want", [("a b c", "b c d", 0.5), ("", "", 1.0), ("a", "", 0.0), (None, "x", 0.0)])
def test_jaccard(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.jaccard(X.token_set(F.col("a")), X.token_set(F.col("b")))).first()[0] == want


def test_settings():
    assert config.setting("retrieval.top_k") == 6 and config.setting("retrieval.nothing.there", 3) == 3


# ---- segmentation ----


def test_sections(spark):
    text = "intro\n# A\nSource page: x\none\n### C\n\n## B\nlast\r\nline\n## Empty\n"
    got = S.sections(spark.createDataFrame([("s", text), ("n", None), ("e", "")], "source_id string, text string")).orderBy("section_no").collect()
    assert [(r.trail, r.body) for r in got] == [([], "intro"), (["A"], "one"), (["A", "B"], "last\nline")]


def test_skipped_levels_compress(spark):
    got = S.sections(spark.createDataFrame([("s", "# A\n### C\nx\n## B\ny")], "source_id string, text string")).orderBy("section_no").collect()
    assert [r.trail for r in got] == [["A", "C"], ["A", "B"]]


def test_packing_of_parts():
    assert S.pack_with_overlap(["a", "b"], 10, 0) == ["a", "b"]
    assert S.pack_with_overlap(["aaaa", "bbbb", "cccc"], 9, 3) == ["aaaa bbbb", "bbbb cccc"]
    assert S.split_recursively("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 5]
    assert S.pack_words("aa bb " + "c" * 9, 5) == ["aa bb", "c" * 9]
    rng = random.Random(0)
    for _ in range(50):
        text = " ".join("".join(rng.choices("ab.\n", k=rng.randint(1, 9))) for _ in range(80))
        pieces = S.split_recursively(text, 60, 0)
        assert all(0 < len(p) <= 60 for p in pieces)


def docs(spark, texts):
    rows = [(f"s{i}", "Scheme", "cat", "plan", "u", "Title", t, "2026-01-01T00:00:00Z", 200, None) for i, t in enumerate(texts)]
    from passagemill import schemas

    return spark.createDataFrame(rows, schemas.RAW_DOC)


@pytest.mark.parametrize("name", ["recursive", "heading_bound", "semantic"])
def test_passages(spark, name):
    long = "# Head\n" + " ".join(f"Sentence number {i} says something of its own kind." for i in range(60)) + "\n## Tail\ntwo words"
    got = S.passages(docs(spark, [long, "short text of five words", None]), name).orderBy("source_id", "chunk_index").collect()
    by = {s: [r for r in got if r.source_id == s] for s in ("s0", "s1")}
    assert all([r.chunk_index for r in rows] == list(range(len(rows))) for rows in by.values())
    assert all(r.word_count >= 3 and r.char_len == len(r.text) for r in got)
    assert len({r.chunk_id for r in got}) == len(got)
    assert by["s0"][0].heading_trail == ["Scheme", "Title", "Head"] and by["s0"][0].embed_text.startswith("Scheme > Title > Head\n\n")


def test_unknown_strategy():
    with pytest.raises(ValueError):
        S.strategy("none", 1, 0)


def test_budget_is_kept_and_counted(spark):
    # the cap holds for the encoded text; overlong words can't be saved
    text = " ".join(f"word{i}" for i in range(900)) + ". End of it."
    chunks = S.passages(docs(spark, [text, "fits the budget well"]), size=9000, overlap=0)
    kept, report = S.enforce_budget(chunks, 120, 100)
    rows = kept.orderBy("source_id", "chunk_index").collect()
    assert all(S.estimate(r.text) <= 120 for r in rows)
    assert [r.chunk_index for r in rows if r.source_id == "s0"] == list(range(sum(r.source_id == "s0" for r in rows)))
    r = report.first()
    assert (r.kept, r.rescued, r.dropped) == (len(rows), 1, 0)
    kept, lost = S.rescue("a " * 400, 1, 100)
    assert kept == [] and lost == sum(len(S.pack_words(p, 120)) for p in S.pack_sentences("a " * 400, 120))


# ---- guards ----


def test_identifiers(spark):
    text = "Call 9876543210, account 123456789012, otp is 1234, a@b.co, ABCDE1234F, number 9999999999"
    spans = G.identifier_spans(text)
    assert {(text[a:b].split()[-1], n) for a, b, n in spans} == {
        ("9876543210", "phone"), ("123456789012", "account"), ("1234", "otp"), ("a@b.co", "email"), ("ABCDE1234F", "pan"), ("9999999999", "phone")
    }
    # markers go in from the last place to the first, in whatever order the rules found the places
    assert one(spark, G.redact(F.col("x"), G.identifiers(F.col("x"))), "ABCDE1234F then a@b.co") == "[REDACTED:pan] then [REDACTED:email]"
    assert one(spark, G.redact(F.col("x"), G.identifiers(F.col("x"))), "nothing") == "nothing"
    assert one(spark, G.categories(G.identifiers(F.col("x"))), None) == []
    assert one(spark, G.describe(F.array(F.lit("pan"), F.lit("otp"))), "x") == "PAN, one-time code"


@pytest.mark.parametrize(
    "question, kind, matched",
    [
        ("", "abstain", "empty"), (None, "abstain", "empty"), ("Should I buy Oak Fund?", "refusal", "buy_sell_hold"), ("What CAGR since launch?", "perf_redirect", "returns_and_cagr"),
        ("Should I invest given its returns of 5?", "refusal", "buy_sell_hold"), ("What is my folio number?", "abstain", "personal_account_data"), ("What is the exit load of Elm Growth Fund?", "abstain", "unlisted_scheme"),
        ("Who won the match?", "abstain", "off_topic"), ("What is the exit load of Oak Large Cap Fund?", "factual", ""), ("exit load of Oak Fund", "factual", ""),
    ],
)
def test_routes(spark, question, kind, matched):
    r = one(spark, G.route(F.col("x"), ["Oak Large Cap Fund", "oak flexi"]), question)
    assert (r.kind, r.matched) == (kind, matched)


def test_scheme_is_the_tightest(spark):
    schemes = [("a", "Oak Large Cap Fund Direct"), ("b", "Oak Large Cap Fund"), ("c", "Elm Fund")]
    ask = lambda q: one(spark, G.detect_scheme(F.col("x"), schemes), q)
    assert ask("load of Oak Large Cap Fund?") == "b" and ask("load of Oak Mid Cap Fund?") is None and ask(None) is None


def test_replies(spark):
    df = spark.createDataFrame(REPLIES, "id string, raw string, hits array<struct<rank:int,url:string,fetched_at:string>>")
    got = {r.id: r for r in validate.validated(df, F.lit("2026-04-20").cast("timestamp")).collect()}
    assert {k: r.kind for k, r in got.items()} == {
        "good": "factual", "stale": "factual", "long": "factual", "pii": "pii_notice", "return": "perf_redirect", "percent": "perf_redirect", "unsourced": "abstain", "refused": "refusal",
        "elsewhere": "abstain", "empty": "abstain", "broken": "error",
    }
    assert [s.step for s in got["good"].steps] == ["parse", "pii_output", "c4_performance", "citation_present", "citation_provenance", "sentences", "freshness"]
    assert [s.step for s in got["pii"].steps] == ["parse", "pii_output"] and not got["pii"].steps[-1].ok
    assert got["stale"].reason == "stale_source" and got["long"].answer == "One. Two of it. Three of it." and got["long"].sources == ["https://pages.example/a"]


def test_fee_percentages_are_no_claims():
    assert validate.return_claim("The expense ratio is 0.78%.") is None
    assert validate.return_claim("Growth was strong. The exit load is 1%.") is None
    assert validate.return_claim("It is 3%.") == "unexplained_percentage"


# ---- extraction ----


def test_pages(spark):
    good, bad = extraction.documents(spark.createDataFrame(PAGES, "url string, html string"))
    got = {r.url.rsplit("/", 1)[1]: r for r in good.collect()}
    assert set(got) == {"full", "bare", "text"} and [r.url for r in bad.collect()] == ["https://pages.example/short"]
    full = got["full"].text
    for line in ("Lock-in of Oakmere Growth Fund: 3 years 1 month.", "Risk level (riskometer) of Oakmere Growth Fund: High.", "Fund management of Oakmere Growth Fund: Ann Reed, Cy Marsh.", "### Who answers?", "With a form & a signature ."):
        assert line in full
    assert "99.9" not in full and "returns" not in full and got["full"].faq.excluded == 1
    assert "Bare Fund is measured against the benchmark X." in got["bare"].text and "Lock-in of Bare Fund: none." in got["bare"].text and "Fund management of Bare Fund: Di Fox." in got["bare"].text
    with pytest.raises(ValueError, match="short"):
        extraction.require_all(good, bad)


# ---- vectors and search ----


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ROW_BLOCK", 37)
    monkeypatch.setattr(V, "QUERY_BLOCK", 11)
    x = np.random.default_rng(1).normal(size=(200, 8))
    x[5] = x[3]
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "row_id long, vector array<float>, label int")
    u = x.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for same in (None, "label"):
        got = {(r.query_id, r["rank"]): r.row_id for r in V.nearest(rows, rows.where("row_id < 40").withColumnRenamed("row_id", "query_id"), 4, same).collect()}
        for q in range(40):
            order = sorted((i for i in range(200) if i != q and (not same or i % 3 == q % 3)), key=lambda i: (-round(float(u[i] @ u[q]), 6), i))[:4]
            assert [got[q, r] for r in range(1, 5)] == order


def test_embedding_uses_the_cache(spark):
    chunks = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", "z"), ("d", "old")], "chunk_id string, embed_text string")
    known = spark.createDataFrame([("old", [1.0, 2.0])], "t string, embedding array<float>").select(V.cache_key("m", F.sha2("t", 256)).alias("key"), "embedding")
    vectors, counts = V.embed(chunks, known, "m")
    got = {r.chunk_id: r.embedding for r in vectors.collect()}
    assert got["a"] == got["b"] and got["d"] == [1.0, 2.0] and tuple(counts.first()) == (4, 1, 2)


def test_guarded_search(spark):
    texts = {"p": "alpha beta gamma", "q": "alpha beta gamma", "r": "delta " * 30, "s": "other words", "t": "more words here", "u": "last"}
    scores = {"p": 0.9, "q": 0.8, "r": 0.7, "s": 0.35, "t": 0.349999, "u": 0.6}
    hits = spark.createDataFrame([("x", k, scores[k], 1, texts[k]) for k in texts] + [("y", "t", 0.1, 1, "low")], "query_id string, row_id string, score double, rank int, text string")
    kept, counts = V.guarded(hits, 0.35, 3, 0.9, 50)
    assert [(r.row_id, r["rank"]) for r in kept.orderBy("rank").collect()] == [("p", 1), ("r", 2)]
    c = {r.query_id: r for r in counts.collect()}
    assert (c["x"].fetched, c["x"].kept, c["x"].filtered, c["x"].deduped, c["x"].truncated, c["x"].dropped) == (6, 2, 1, 1, 2, 3)
    assert (c["y"].fetched, c["y"].kept, c["y"].filtered) == (1, 0, 1)
    # the first hit stays, however long
    assert V.within_budget(hits.where("row_id = 'r'"), 5).count() == 1


def test_dedupe_compares_with_kept_rows_only(spark):
    # b is close to a and c to b, but c is not close to a: c stays
    rows = [("x", "a", 0.9, "1 2 3 4 5 6 7 8 9 10"), ("x", "b", 0.8, "1 2 3 4 5 6 7 8 9 10 11"), ("x", "c", 0.7, "1 2 3 4 5 6 7 8 9 11 12")]
    df = spark.createDataFrame(rows, "query_id string, row_id string, score double, text string")
    assert {r.row_id for r in V.greedy_dedupe(df, 0.8).collect()} == {"a", "c"}


# ---- store and files ----


def test_store(spark, tmp_path):
    chunks = S.passages(docs(spark, ["# H\nsome words of text", "other words of text"])).withColumn("scheme_slug", F.lit(None).cast("string"))
    back = store.from_metadata(store.to_metadata(chunks.withColumn("char_len", F.lit(0))))
    pick = lambda df: sorted(map(tuple, df.select("chunk_id", "heading_trail", "char_len", "embed_text").collect()))
    assert pick(back) == pick(chunks)
    first, second = chunks.where("source_id = 's0'"), chunks.withColumn("text", F.lit("new"))
    merged = store.upsert(first, second)
    again = store.upsert(merged, second)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, again.collect())) and merged.count() == 2
    assert store.orphans(chunks, first).count() == 1
    path = str(tmp_path / "t")
    files.replace_table(merged, path)
    files.replace_table(spark.read.parquet(path).where("source_id = 's0'"), path)
    assert spark.read.parquet(path).count() == 1


def test_files(spark, tmp_path):
    p = str(tmp_path)
    rows = docs(spark, ["one two", "three"])
    from passagemill import schemas

    files.write_json_lines(rows, p + "/raw")
    assert files.read_json_lines(spark, p + "/raw", schemas.RAW_DOC).count() == 2
    (tmp_path / "bad.json").write_text('{"source_id": "a"}\n\nnot json\n')
    assert files.read_json_lines(spark, p + "/bad.json", schemas.RAW_DOC, tolerant=True).where("source_id is not null").count() == 1
    with pytest.raises(Exception):
        files.read_json_lines(spark, p + "/missing", schemas.RAW_DOC).count()
    files.write_sources_csv(rows, p + "/csv", "n")
    assert spark.read.option("header", True).csv(p + "/csv").where("source_id = 's0'").first().word_count == "2"
    files.write_vectors(spark.createDataFrame([("a", [0.123456789])], schemas.VECTOR), p + "/v")
    assert files.read_vectors(spark, p + "/v").count() == 1 and files.read_vectors(spark, p + "/none").count() == 0
    (tmp_path / "gold.json").write_text('{"questions": [{"id": "g", "question": "q", "must_include": ["x"]}]}')
    assert files.read_gold(spark, p + "/gold.json").first().must_include == ["x"]
    assert files.append_metrics(spark, p + "/m", [{"stage": "load", "ok": True, "question": "never written"}])
    assert "never" not in str(spark.read.json(p + "/m").collect()) and files.status(spark, {"v": p + "/v", "w": p + "/w"}) == {"v": 1, "w": None}


def test_allow_lists(spark):
    pages = spark.createDataFrame([("https://a.example/x/",), ("https://a.example/y",), ("https://blog.medium.com/z",), (None,), ("not a url",)], "url string")
    sources = spark.createDataFrame([("s", "https://a.example/x"), ("t", "https://a.example/none")], "source_id string, url string")
    assert [r.url for r in store.allowed(pages, sources).collect()] == ["https://a.example/x/"]
    assert [r.url for r in pages.where(store.is_denied(F.col("url"))).collect()] == ["https://blog.medium.com/z"]
    docs_ = spark.createDataFrame([("s", "https://a.example/x/", 1), ("s", "https://a.example/x", 2), ("q", "https://a.example/x", 3)], "source_id string, url string, raw_id int")
    kept, missing = store.replay(docs_, sources, F.col("raw_id"))
    assert [r.raw_id for r in kept.collect()] == [2] and [r.source_id for r in missing.collect()] == ["t"]


# ---- evaluation ----


def test_p95_and_summary(spark):
    for n in (1, 2, 11, 20, 31, 100):
        values = random.Random(n).sample(range(1000), n)
        df = spark.createDataFrame([(v,) for v in values], "v int")
        want = sorted(values)[min(n - 1, round(0.95 * (n - 1)))]
        assert df.agg(E.p95(F.col("v"))).first()[0] == want == E.p95_of_counts(df, "v").first()[0]
    assert tuple(E.summary(spark.createDataFrame([], "text string, source_id string")).first()) == (0, 0, 0, 0, 0)


def test_grid(spark):
    g = spark.createDataFrame(GRID, "cell_no int, strategy string, size int, recall_at_5 double, n_chunks int, mean_chars double, max_tokens int, skipped boolean")
    assert E.grid_winner(g).first().cell_no == 1
    assert {r.strategy: r.cell_no for r in E.best_per_strategy(g).collect()} == {"recursive": 1, "heading_bound": 2, "semantic": 3}
    assert E.grid_winner(g.where("skipped")).count() == 0


def test_hits_and_reasons(spark):
    gold = spark.createDataFrame([("a", "s", "Nil"), ("b", "s", "Nil"), ("c", "s", "Nil"), ("d", "s", "Nil")], "id string, expected_source_id string, answer_span string")
    ranked = spark.createDataFrame([("a", 1, "t", "nil"), ("a", 2, "s", "is nil."), ("b", 1, "s", "other"), ("c", 1, "t", "x")], "question_id string, rank int, source_id string, text string")
    o = E.first_hits(gold, ranked)
    assert {r.id: r.reason for r in o.withColumn("reason", E.reason(F.lit("s"), F.lit(None).cast("string"))).collect()} == {"a": None, "b": "span_absent", "c": "scheme_absent", "d": "nothing_above_floor"}
    s = E.scores(o).first()
    assert (s.hit_at_1, s.hit_at_3, s.scheme_at_1, s.mrr) == (0.0, 0.25, 0.25, 0.125)


# ---- streaming ----


def test_streaming_ingest(spark, tmp_path):
    from passagemill.streaming.ingest import ingest

    landing, target, mark = (str(tmp_path / x) for x in ("landing", "store", "mark"))
    docs(spark, ["first words of text", "second words of text"]).write.json(landing)
    ingest(spark, landing, target, mark).awaitTermination(120)
    assert spark.read.parquet(target).count() == 2
    docs(spark, ["first words are new now"]).write.mode("append").json(landing)
    ingest(spark, landing, target, mark).awaitTermination(120)
    rows = {r.source_id: r.text for r in spark.read.parquet(target).collect()}
    assert rows == {"s0": "first words are new now", "s1": "second words of text"}
