"""Vectors of passages: encoding with a cache, exact search in blocks, and the guarded search on top of it."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from passagemill.config import setting
from passagemill.functions import text as X

#: Rows and queries that one task multiplies.
ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048


def hashing_vectors(texts: list[str], dimension: int = 384) -> np.ndarray:
    """Deterministic unit vectors of hashed words, the stand-in for a sentence encoder."""
    out = np.zeros((len(texts), dimension))
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out[i, h % dimension] += 1 if h & 0x80000000 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def encode(text: pd.Series) -> pd.Series:
    return pd.Series(list(hashing_vectors(text.tolist()).astype(np.float32)))


def unit(vector: Column) -> Column:
    """A vector of length one; zero vectors stay."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def cache_key(model: str, content_hash: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("::"), content_hash), 256)


def embed(chunks: DataFrame, cache: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, embedding of every chunk; one row of counters: total, hits, misses).

    Each distinct text to encode is encoded once, and not at all if the cache (key, embedding) holds it. The key is of
    the text that is encoded, headings included.
    """
    keyed = chunks.select("chunk_id", "embed_text", cache_key(model or setting("embedding.model_id"), F.sha2("embed_text", 256)).alias("key"))
    known = keyed.join(cache.select("key", F.col("embedding").alias("_known")), "key", "left")
    new = known.where(F.col("_known").isNull()).dropDuplicates(["key"]).select("key", encode("embed_text").alias("_new"))
    vectors = known.join(new, "key", "left").select("chunk_id", F.coalesce("_known", "_new").alias("embedding"))
    counts = known.agg(F.count("*").alias("total"), F.count("_known").alias("hits"), F.countDistinct(F.when(F.col("_known").isNull(), F.col("key"))).alias("misses"))
    return vectors, counts


def norm_audit(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows, distinct dimensions, and vectors whose length differs from one by more than 0.01."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.agg(
        F.count("*").alias("n_vectors"),
        F.countDistinct(F.size(vector)).alias("n_dimensions"),
        F.count_if(F.abs(norm - 1) > 0.01).alias("n_bad_norm"),
    )


def nearest(rows: DataFrame, queries: DataFrame, n: int, same: str | None = None) -> DataFrame:
    """(query_id, row_id, score, rank): the ``n`` rows (row_id, vector) of highest cosine for each query (query_id,
    vector), never the row of the same id, ties by id. With ``same``, only rows equal to the query in that column.

    Rows and queries meet in a grid of blocks of bounded size; a task returns the best of its block only.
    """
    r_blocks = max(1, -(-rows.count() // ROW_BLOCK))
    q_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    extra = [same] if same else []
    left = rows.select("row_id", "vector", *extra).withColumn("r", F.pmod(F.xxhash64("row_id"), F.lit(r_blocks))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    right = queries.select("query_id", "vector", *extra).withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))))
    id_type = rows.schema["row_id"].dataType.simpleString()

    def best(rows_pdf: pd.DataFrame, queries_pdf: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = [], [], []
        if len(rows_pdf) and len(queries_pdf):
            x, y = (np.stack(p["vector"].to_list()).astype(np.float64) for p in (rows_pdf, queries_pdf))
            x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
            score = np.round(y @ x.T, 6)
            ids = rows_pdf["row_id"].to_numpy()
            score[queries_pdf["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
            if same:
                score[queries_pdf[same].to_numpy()[:, None] != rows_pdf[same].to_numpy()[None, :]] = -np.inf
            by_id = np.argsort(ids, kind="stable")
            for q, s in zip(queries_pdf["query_id"], score):
                top = by_id[np.argsort(-s[by_id], kind="stable")[:n]]
                top = top[np.isfinite(s[top])]
                for values, new in zip(found, ([q] * len(top), ids[top].tolist(), s[top].tolist())):
                    values += new
        kind = "object" if id_type == "string" else "int64"
        return pd.DataFrame({"query_id": pd.Series(found[0], dtype=kind), "row_id": pd.Series(found[1], dtype=kind), "score": pd.Series(found[2], dtype="float64")})

    part = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(best, f"query_id {id_type}, row_id {id_type}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= n)


def _greedy(rows: Column, threshold: float) -> Column:
    """An array of rows with tokens, without those too similar to an earlier one that was kept."""
    none = F.filter(rows, lambda _: F.lit(False))
    return F.aggregate(rows, none, lambda acc, c: F.when(F.exists(acc, lambda k: X.jaccard(k["tokens"], c["tokens"]) > threshold), acc).otherwise(F.concat(acc, F.array(c))))


def greedy_dedupe(hits: DataFrame, threshold: float, key: str = "query_id") -> DataFrame:
    """Hits in order of score, without those too similar to one that was kept; ``text`` is compared by its tokens.

    The lists that are folded hold at most the number of results of one search.
    """
    row = F.struct((-F.col("score")).alias("order"), "row_id", X.token_set(F.col("text")).alias("tokens"))
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("all"))
    return hits.join(listed.select(key, F.explode(F.transform(_greedy(F.col("all"), threshold), lambda k: k["row_id"])).alias("row_id")), [key, "row_id"], "left_semi")


def within_budget(hits: DataFrame, budget: int, key: str = "query_id", order: tuple = ("rank",)) -> DataFrame:
    """The longest beginning of each list whose texts fit the budget; the first hit always stays."""
    w = Window.partitionBy(key).orderBy(*order)
    cost = F.sum(X.token_estimate(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("_cost", cost).withColumn("_no", F.row_number().over(w)).where((F.col("_no") == 1) | (F.col("_cost") <= budget)).drop("_cost", "_no")


def guarded(hits: DataFrame, floor: float | None = None, top_k: int | None = None, dedupe: float | None = None, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, row_id, score, rank, text) after floor, dedupe, cut and budget, ranked anew from 1; and per query
    the counters fetched, kept, filtered, deduped, truncated and dropped. A query without any hit left keeps its row."""
    floor, top_k = setting("retrieval.score_floor") if floor is None else floor, top_k or setting("retrieval.top_k")
    dedupe, budget = setting("retrieval.dedupe_jaccard") if dedupe is None else dedupe, budget or setting("retrieval.max_context_tokens")
    row = F.struct((-F.col("score")).alias("order"), "row_id", X.token_set(F.col("text")).alias("tokens"), X.token_estimate(F.col("text")).alias("cost"))
    # one list for each query, as long as one search has results
    listed = hits.groupBy("query_id").agg(F.count("*").alias("fetched"), F.array_sort(F.collect_list(F.when(F.col("score") >= floor, row))).alias("above"))
    start = F.struct(F.filter("above", lambda _: F.lit(False)).alias("kept"), F.lit(0).cast("long").alias("spent"), F.transform(F.filter("above", lambda _: F.lit(False)), lambda r: r["row_id"]).alias("final"))

    def take(acc: Column, c: Column) -> Column:
        n, spent = F.size(acc["kept"]), acc["spent"] + c["cost"]
        fits = (n < top_k) & ((n == 0) | (spent <= budget))
        more = F.struct(F.concat(acc["kept"], F.array(c)).alias("kept"), spent.alias("spent"), F.when(fits, F.concat(acc["final"], F.array(c["row_id"]))).otherwise(acc["final"]).alias("final"))
        return F.when(F.exists(acc["kept"], lambda k: X.jaccard(k["tokens"], c["tokens"]) > dedupe), acc).otherwise(more)

    # exploded so that the fold is evaluated once, whatever is made of its result
    folded = F.explode(F.array(F.aggregate("above", start, take))).alias("_r")
    listed = listed.select("query_id", "fetched", F.size("above").cast("long").alias("above"), folded)
    places = listed.select("query_id", F.posexplode("_r.final").alias("_no", "row_id")).select("query_id", "row_id", (F.col("_no") + 1).alias("rank"))
    final = hits.drop("rank").join(places, ["query_id", "row_id"]).select(*hits.columns)
    n = lambda c: F.size(c).cast("long")
    return final, listed.select(
        "query_id",
        "fetched",
        n("_r.final").alias("kept"),
        (F.col("fetched") - F.col("above")).alias("filtered"),
        (F.col("above") - n("_r.kept")).alias("deduped"),
        (n("_r.kept") - n("_r.final")).alias("truncated"),
        (F.col("fetched") - F.col("above") + n("_r.kept") - n("_r.final")).alias("dropped"),
    )
