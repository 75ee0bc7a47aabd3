"""Queries of the core over a folder of tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagemill.functions import rules as R, text as X
from passagemill.operators import evaluate as E, extraction, guards as G, segmentation as S, snapshots, store, sweep, vectors as V
from passagemill.plans import answer
from passagemill.plans.fixtures import GRID, PAGES, PROBES, REPLIES
from passagemill.session import cut_lineage
from passagemill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    """Register a query under its name, with the SQL of that name if there is one."""
    QUERIES[f.__name__] = f
    path = Path(__file__).parent / "sql" / f"{f.__name__}.sql"
    if path.exists():
        SQL[f.__name__] = path.read_text()
    return f


# ---- snapshots ----


@query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and passages that were added, removed or changed from each snapshot to the next."""
    states = snapshots.page_states(table(spark, folder, "raw_doc")).unionByName(snapshots.passage_states(table(spark, folder, "chunk")))
    return snapshots.snapshot_changes(states)


def _current(spark: SparkSession, folder: str, keep: list[str], only: DataFrame | None = None) -> DataFrame:
    """Current rows of the last snapshot of ``chunk``; with ``only``, of these chunk_ids."""
    chunk = table(spark, folder, "chunk")
    last = chunk.agg(F.max("snapshot_no").alias("snapshot_no"))
    rows = chunk.join(F.broadcast(last), "snapshot_no", "left_semi")
    if only is not None:
        rows = rows.join(only.select("chunk_id"), "chunk_id", "left_semi")
    return snapshots.latest_rows(rows, ["chunk_id"], F.try_to_timestamp("fetched_at"), keep)


# ---- vectors ----


def _blocks(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 50."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")
    return e, e.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")


@query
def vec_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The twelve nearest other vectors of each query."""
    return V.nearest(*_blocks(spark, folder), 12)


@query
def vec_filtered_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same among vectors with the query's own label; the filter comes before the cut."""
    return V.nearest(*_blocks(spark, folder), 12, same="label")


@query
def vec_search_floor(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch wide, keep what reaches the floor, cut to six, rank anew."""
    return V.nearest(*_blocks(spark, folder), 12).where("score >= 0.35 and rank <= 6")


@query
def vec_closest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest other vector of each query."""
    return V.nearest(*_blocks(spark, folder), 1).drop("rank")


@query
def vec_norm_audit(spark: SparkSession, folder: str) -> DataFrame:
    return V.norm_audit(table(spark, folder, "embeddings"))


@query
def vec_unit(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each vector after normalisation."""
    e = table(spark, folder, "embeddings").select("vec_id", V.unit(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


@query
def vec_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Hit rates and mean reciprocal rank when an equal label counts as a hit."""
    rows, queries = _blocks(spark, folder)
    labels = rows.select("row_id", F.col("label").alias("row_label"))
    ranked = V.nearest(rows, queries, 6).join(labels, "row_id").join(queries.select("query_id", "label"), "query_id")
    outcomes = queries.select("query_id").join(ranked.where("row_label = label").groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    return E.scores(outcomes.withColumn("scheme_rank", F.col("rank")))


# ---- documents ----


@query
def doc_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query
def doc_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Size of the collection per domain."""
    d = table(spark, folder, "documents").withColumn("words", X.word_count(F.col("text")))
    return d.groupBy("domain").agg(F.count("*").alias("n_docs"), F.round(F.avg("words"), 1).alias("mean_words"), F.sum("words").alias("n_words"), F.max(X.token_estimate(F.col("text"))).alias("max_tokens"))


@query
def doc_p95(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest-rank 95 % of lengths per domain."""
    d = table(spark, folder, "documents").select("domain", F.length("text").alias("chars"))
    return E.p95_of_counts(d, "chars", "domain")


@query
def doc_hash_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text is not null")
    return d.select("doc_id", X.hash16(F.col("source"), F.col("doc_id").cast("string")).alias("hash_id"), F.sha2("text", 256).alias("content_hash"), X.query_hash(F.col("text"), "salt").alias("q_hash"), V.cache_key("model", F.sha2("text", 256)).alias("cache_key"))


@query
def doc_token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"), X.token_estimate(F.col("text")).alias("n_tokens"))


@query
def doc_lines_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and boilerplate lines of each document."""
    lines = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(X.is_boilerplate(F.col("line"))).alias("n_boilerplate"))


@query
def doc_content_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of each text, and how many have it."""
    d = table(spark, folder, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


@query
def doc_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"), X.excerpt(X.first_sentences(F.col("text"), 2), 160).alias("start"))


@query
def doc_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of identifiers in documents, and their texts with markers in place of them."""
    d = table(spark, folder, "documents").withColumn("spans", G.identifiers(F.col("text"))).where(F.size("spans") > 0)
    return d.select("doc_id", F.array_join(G.categories(F.col("spans")), ",").alias("kinds"), G.describe(G.categories(F.col("spans"))).alias("labels"), G.redact(F.col("text"), F.col("spans")).alias("redacted"))


@query
def doc_injection(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text tries to steer a model."""
    d = table(spark, folder, "documents").select("doc_id", G.injection(F.col("text")).alias("names"))
    return d.where(F.size("names") > 0).select("doc_id", F.array_join("names", ",").alias("names"))


@query
def doc_similarity_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Token similarity of each document with the next one of its source."""
    from pyspark.sql import Window

    d = table(spark, folder, "documents").where("source is not null")
    tokens = d.select("doc_id", X.token_set(F.col("text")).alias("tokens"))
    # ids are put in order alone; the tokens of both come to the pair
    after = d.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next_id")).where("next_id is not null")
    d = after.join(tokens, "doc_id").join(tokens.select(F.col("doc_id").alias("next_id"), F.col("tokens").alias("next_tokens")), "next_id")
    return d.select("doc_id", "next_id", F.round(X.jaccard(F.col("tokens"), F.col("next_tokens")), 6).alias("similarity"))


# ---- pages and passages ----


@query
def page_allowed(spark: SparkSession, folder: str) -> DataFrame:
    """Current passages whose url is that of a known source, and whether their host is denied."""
    pages = _current(spark, folder, ["url"])
    return store.allowed(pages, table(spark, folder, "source_list")).select("chunk_id", store.is_denied(F.col("url")).alias("denied"))


def _replayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Good pages count for the source whose url theirs continues."""
    docs = table(spark, folder, "raw_doc").where("http_status = 200")
    docs = docs.withColumn("url", F.regexp_replace(store.bare_url(F.col("url")), "/[^/]+$", ""))
    return store.replay(docs, table(spark, folder, "source_list"), F.col("raw_id"))


@query
def page_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The last good page of each source."""
    return _replayed(spark, folder)[0].select("source_id", "raw_id")


@query
def page_missing_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources without any good page."""
    return _replayed(spark, folder)[1]


@query
def page_host_counts(spark: SparkSession, folder: str) -> DataFrame:
    host = F.try_parse_url("url", F.lit("HOST"))
    return table(spark, folder, "raw_doc").groupBy(host.alias("host")).agg(F.count("*").alias("n_pages"), F.sum(X.word_count(F.col("text"))).alias("n_words"))


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_doc").where("text is not null").withColumn("source_id", F.concat_ws("#", "source_id", "raw_id"))


@query
def page_sections(spark: SparkSession, folder: str) -> DataFrame:
    s = S.sections(_docs(spark, folder))
    return s.select("source_id", "section_no", F.array_join("trail", " > ").alias("trail"), F.length("body").alias("n_chars"))


@query
def page_passages(spark: SparkSession, folder: str) -> DataFrame:
    return S.passages(_docs(spark, folder)).select("chunk_id", "source_id", "chunk_index", "char_len", "word_count", "content_hash")


@query
def page_passages_semantic(spark: SparkSession, folder: str) -> DataFrame:
    return S.passages(_docs(spark, folder), "semantic").select("chunk_id", "source_id", "chunk_index", "char_len")


@query
def page_budget_report(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the token budget over long passages."""
    return S.enforce_budget(S.passages(_docs(spark, folder), size=2400, overlap=0))[1]


@query
def chunk_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.summary(_current(spark, folder, ["text", "source_id"]))


@query
def chunk_per_source(spark: SparkSession, folder: str) -> DataFrame:
    """Current passages, newest fetch and over-long texts of each source."""
    c = _current(spark, folder, ["source_id", "fetched_at", "embed_text"])
    return c.groupBy("source_id").agg(F.count("*").alias("n_chunks"), E.newest("fetched_at").alias("newest"), F.count_if(X.token_estimate(F.col("embed_text")) > 256).alias("n_over"))


@query
def chunk_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of current passages as the store takes it."""
    return store.to_metadata(_current(spark, folder, ["text", *(c for c in store.METADATA if c != "chunk_id")])).drop("text", "fetched_at")


@query
def chunk_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Passages rebuilt from their metadata."""
    stored = store.to_metadata(_current(spark, folder, ["text", *(c for c in store.METADATA if c != "chunk_id")]))
    return store.from_metadata(stored).select("source_id", "chunk_index", "chunk_id", "char_len", "word_count", F.size("heading_trail").alias("n_headings"), F.sha2("embed_text", 256).alias("embed_hash"))


def _snapshot(spark: SparkSession, folder: str, no: int) -> DataFrame:
    rows = table(spark, folder, "chunk").where(F.col("snapshot_no") == no)
    return snapshots.latest_rows(rows, ["chunk_id"], F.try_to_timestamp("fetched_at"), ["source_id", "chunk_index", "text"])


@query
def chunk_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The store after snapshot 2 was upserted over snapshot 1, as its SQL has it; chunk_upsert_all takes every snapshot."""
    merged = store.upsert(_snapshot(spark, folder, 1), _snapshot(spark, folder, 2))
    return merged.select("chunk_id", "source_id", F.sha2("text", 256).alias("content"))


@query
def chunk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of snapshot 1 that snapshot 2 no longer has, as its SQL has it; chunk_orphans_all takes every snapshot."""
    return store.orphans(_snapshot(spark, folder, 1), _snapshot(spark, folder, 2)).select("chunk_id", "source_id")


@query
def chunk_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and misses of a cache that holds the texts of snapshot 1, for those of snapshot 2, as its SQL has it;
    chunk_cache_all takes every snapshot."""
    key = F.sha2("text", 256)
    cache = _snapshot(spark, folder, 1).where("text is not null").select(key.alias("key")).distinct().withColumn("held", F.lit(1))
    known = _snapshot(spark, folder, 2).where("text is not null").select("chunk_id", key.alias("key")).join(cache, "key", "left")
    return known.agg(F.count("*").alias("total"), F.count("held").alias("hits"), F.countDistinct(F.when(F.col("held").isNull(), F.col("key"))).alias("misses"))


def _arrived(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows of every snapshot, whatever their number."""
    rows = table(spark, folder, "chunk").where("snapshot_no is not null")
    return snapshots.latest_rows(rows, ["snapshot_no", "chunk_id"], F.try_to_timestamp("fetched_at"), ["source_id", "chunk_index", "text"])


@query
def chunk_upsert_all(spark: SparkSession, folder: str) -> DataFrame:
    """The store after all snapshots were upserted in order: of each passage its row in the last snapshot that has it."""
    rows = _arrived(spark, folder)
    last = rows.groupBy("chunk_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    return rows.join(last, ["chunk_id", "snapshot_no"], "left_semi").select("chunk_id", "source_id", F.sha2("text", 256).alias("content"))


@query
def chunk_orphans_all(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of each snapshot that the next one, snapshot_no, no longer has."""
    from pyspark.sql import Window

    rows = _arrived(spark, folder).select("snapshot_no", "chunk_id", "source_id")
    # a row for each snapshot
    following = rows.select("snapshot_no").distinct().withColumn("next_no", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))).where("next_no is not null")
    due = rows.join(F.broadcast(following), "snapshot_no").select(F.col("next_no").alias("snapshot_no"), "chunk_id", "source_id")
    return due.join(rows.select("snapshot_no", "chunk_id"), ["snapshot_no", "chunk_id"], "left_anti")


@query
def chunk_cache_all(spark: SparkSession, folder: str) -> DataFrame:
    """Hits and misses of a cache that holds the texts of all earlier snapshots, for each snapshot after the first."""
    rows = _arrived(spark, folder)
    known = rows.where("text is not null").select("snapshot_no", F.sha2("text", 256).alias("key"))
    # copies are counted first, so that a hot text is one row of each snapshot
    counts = known.groupBy("key", "snapshot_no").agg(F.count("*").alias("n"))
    first = counts.groupBy("key").agg(F.min("snapshot_no").alias("first_no"))
    held = F.col("first_no") < F.col("snapshot_no")
    after = rows.select("snapshot_no").distinct().join(F.broadcast(rows.agg(F.min("snapshot_no").alias("start"))), F.col("snapshot_no") > F.col("start")).select("snapshot_no")
    found = counts.join(first, "key").groupBy("snapshot_no").agg(F.sum("n").alias("total"), F.sum(F.when(held, F.col("n")).otherwise(0)).alias("hits"), F.count_if(~held).alias("misses"))
    return after.join(found, "snapshot_no", "left").fillna(0, ["total", "hits", "misses"])


@query
def chunk_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of current passages by the built-in encoder, each distinct text encoded once."""
    chunks = _current(spark, folder, ["embed_text"]).where("embed_text is not null")
    empty = spark.createDataFrame([], "key string, embedding array<float>")
    return V.norm_audit(V.embed(chunks, empty)[0])


@query
def chunk_with_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Current passages per source, and how many have a vector."""
    v = table(spark, folder, "chunk_vector").where("embedding is not null").select("chunk_id").distinct().withColumn("has", F.lit(1))
    return _current(spark, folder, ["source_id"]).join(v, "chunk_id", "left").groupBy("source_id").agg(F.count("*").alias("n_chunks"), F.count("has").alias("n_vectors"))


# ---- searches and questions ----


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Past searches with the texts that they found: query_id, row_id, score, rank, text, url, source_id, fetched_at."""
    r = table(spark, folder, "retrieved_chunk").where("score is not null")
    best = r.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"))
    c = _current(spark, folder, ["text", "url", "source_id", "fetched_at"], best).where("text is not null")
    return best.join(c, "chunk_id").select(F.col("question_id").alias("query_id"), F.col("chunk_id").alias("row_id"), F.round("score", 6).alias("score"), "text", "url", "source_id", "fetched_at")


def _top(spark: SparkSession, folder: str, n: int = 12) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return _hits(spark, folder).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


@query
def search_guarded(spark: SparkSession, folder: str) -> DataFrame:
    """Results of each question after floor, near-duplicate removal, cut and token budget."""
    return V.guarded(_top(spark, folder))[0].select("query_id", "row_id", "score", "rank")


@query
def search_counters(spark: SparkSession, folder: str) -> DataFrame:
    return V.guarded(_top(spark, folder))[1]


@query
def search_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The beginning of each result list that fits 500 tokens."""
    return V.within_budget(_top(spark, folder), 500).select("query_id", "row_id", "rank")


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    ranked = _top(spark, folder, 6).select(F.col("query_id").alias("question_id"), "rank", "source_id", "text")
    return E.first_hits(table(spark, folder, "gold_question"), ranked)


@query
def gold_first_hits(spark: SparkSession, folder: str) -> DataFrame:
    """First rank with the right source and span, and with the right source, of each gold question."""
    return _gold(spark, folder)


@query
def gold_scores(spark: SparkSession, folder: str) -> DataFrame:
    return E.scores(_gold(spark, folder))


@query
def gold_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """How many gold questions missed for which reason."""
    named = G.detect_scheme(F.col("question"), _names(spark, folder)).alias("detected")
    o = _gold(spark, folder).join(table(spark, folder, "gold_question").select("id", "expected_source_id", named), "id")
    return o.groupBy(F.coalesce(E.reason(F.col("expected_source_id"), F.col("detected")), F.lit("hit")).alias("reason")).agg(F.count("*").alias("n"))


def _names(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The list of sources is a closed table of a few hundred rows."""
    rows = table(spark, folder, "source_list").where("scheme_name is not null").select("source_id", "scheme_name").orderBy("source_id").collect()
    return [tuple(r) for r in rows]


@query
def question_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Route of each gold question and probe."""
    q = table(spark, folder, "gold_question").select("id", "question").unionByName(table(spark, folder, "pii_probes").select("id", "question").distinct())
    names = sorted({n for _, n in _names(spark, folder)})
    return q.select("id", G.route(F.col("question"), names).alias("r")).select("id", "r.kind", "r.label", "r.matched")


@query
def question_schemes(spark: SparkSession, folder: str) -> DataFrame:
    """The scheme that each gold question names."""
    return table(spark, folder, "gold_question").select("id", G.detect_scheme(F.col("question"), _names(spark, folder)).alias("slug"))


@query
def question_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that hit the rules which need no look-ahead."""
    q = table(spark, folder, "pii_probes").select("id", "question").distinct().where("question is not null")
    rules = {n: R.ABSENT[n] for n in ("personal_account_data", "account_operations")} | {"nav": R.PERFORMANCE["nav"], "recommendation": R.ADVICE["recommendation"]}
    return q.select("id", F.explode(G.matching(F.col("question"), rules)).alias("rule"))


@query
def question_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the offline backend to all gold questions."""
    hits = V.guarded(_top(spark, folder))[0].withColumnRenamed("query_id", "question_id")
    return answer.answers(table(spark, folder, "gold_question").select("id", "question"), hits, sorted({n for _, n in _names(spark, folder)}), F.lit("2026-04-20").cast("timestamp"))


@query
def search_questions(spark: SparkSession, folder: str) -> DataFrame:
    """The six current passages nearest to each gold question by the built-in encoder; where the question names a scheme,
    among the passages of that scheme only. The filter comes before the cut."""
    chunks = _current(spark, folder, ["embed_text", "source_id"]).where("embed_text is not null")
    rows = cut_lineage(chunks.select(F.col("chunk_id").alias("row_id"), "source_id", V.encode("embed_text").alias("vector")))
    asked = table(spark, folder, "gold_question").where("question is not null")
    asked = cut_lineage(asked.select(F.col("id").alias("query_id"), G.detect_scheme(F.col("question"), _names(spark, folder)).alias("source_id"), V.encode("question").alias("vector")))
    within = V.nearest(rows, asked.where("source_id is not null"), 6, same="source_id")
    return within.unionByName(V.nearest(rows, asked.where("source_id is null"), 6))


@query
def search_question_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the gold questions whose expected source, and whose answer, is among the six passages of that search."""
    texts = _current(spark, folder, ["text", "source_id"]).select(F.col("chunk_id").alias("row_id"), "text", "source_id")
    ranked = search_questions(spark, folder).join(texts, "row_id").select(F.col("query_id").alias("question_id"), "rank", "source_id", "text")
    return E.scores(E.first_hits(table(spark, folder, "gold_question"), ranked))


@query
def chunk_upsert_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Passages with vectors of the last snapshot upserted over those of the first: source and length of vector."""
    v = table(spark, folder, "chunk_vector").where("size(embedding) = 384").select("chunk_id", "embedding").dropDuplicates(["chunk_id"])
    old = store.with_vectors(_snapshot(spark, folder, 1).select("chunk_id", "source_id"), v)
    new = store.with_vectors(_current(spark, folder, ["source_id"]), v)
    return store.upsert(old, new.select(*old.columns)).select("chunk_id", "source_id", F.size("embedding").alias("dimension"))


@query
def question_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks that a model would be given for each question: their number, and the hash of the whole."""
    hits = V.guarded(_top(spark, folder))[0]
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "text"))).alias("hits"))
    return listed.select(F.col("query_id").alias("id"), F.size("hits").alias("n_blocks"), F.sha2(answer.context("hits"), 256).alias("blocks"))


# ---- literal inputs, for what no table holds ----


@query
def fixture_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with structured data to documents."""
    good, bad = extraction.documents(spark.createDataFrame(PAGES, "url string, html string"))
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).select("url", "ok", "page_title", F.col("faq.excluded").alias("excluded"), F.size("facts").alias("n_facts"), "text")


@query
def fixture_probes(spark: SparkSession, folder: str) -> DataFrame:
    """Injection rules on probes."""
    return spark.createDataFrame(PROBES, "id string, text string").select("id", F.array_join(G.injection(F.col("text")), ",").alias("names"))


@query
def fixture_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered checks on replies of a model."""
    from passagemill.operators import validate

    df = spark.createDataFrame(REPLIES, "id string, raw string, hits array<struct<rank:int,url:string,fetched_at:string>>")
    return validate.validated(df, F.lit("2026-04-20").cast("timestamp")).select("id", "kind", "reason", "answer", F.array_join("sources", " ").alias("sources"))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRID, "cell_no int, strategy string, size int, recall_at_5 double, n_chunks int, mean_chars double, max_tokens int, skipped boolean")


@query
def grid_winner(spark: SparkSession, folder: str) -> DataFrame:
    return E.grid_winner(_grid(spark)).select("cell_no", "strategy", "size")


@query
def grid_best_per_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return E.best_per_strategy(_grid(spark)).select("strategy", "cell_no")


@query
def sweep_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, sizes and counters of the budget of every chunking setting of the grid, over all pages."""
    docs = _docs(spark, folder).withColumn("page_source", F.element_at(F.split("source_id", "#"), 1))
    return sweep.sweep(docs, table(spark, folder, "gold_question"))


@query
def sweep_winner(spark: SparkSession, folder: str) -> DataFrame:
    """The setting that wins the sweep over the pages."""
    return E.grid_winner(sweep_recall(spark, folder)).select("cell_no", "strategy", "size", "overlap_chars", "recall_at_5")


@query
def sweep_best_per_strategy(spark: SparkSession, folder: str) -> DataFrame:
    return E.best_per_strategy(sweep_recall(spark, folder)).select("strategy", "cell_no", "recall_at_5")


# ---- plain relational queries on the star schema, as smoke tests ----


@query
def star_pricing(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query
def star_nation_orders(spark: SparkSession, folder: str) -> DataFrame:
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
