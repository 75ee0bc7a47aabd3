"""Quality of retrieval and of chunking settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagemill.functions import text as X


def p95(values: Column) -> Column:
    """Nearest-rank value at 95 %: of n sorted values the one at round(0.95 (n - 1)), halves to even."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.bround(0.95 * (F.size(ordered) - 1), 0).cast("int") + 1)


def p95_of_counts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The same for groups of any size: values are counted first, and the rank is found among the counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    return ranked.where(F.col("upto") > F.bround(0.95 * (F.col("total") - 1), 0)).groupBy(*keys).agg(F.min(value).alias(f"p95_{value}"))


def summary(chunks: DataFrame) -> DataFrame:
    """Count, mean lengths, largest estimate and documents of passages; zeros for none."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.agg(
        F.count("*").alias("n_chunks"),
        zero(F.round(F.avg(F.length("text")), 1)).alias("mean_chars"),
        zero(F.round(F.avg(X.word_count(F.col("text"))), 1)).alias("mean_words"),
        zero(F.max(X.token_estimate(F.col("text")))).alias("max_tokens"),
        F.countDistinct("source_id").alias("n_docs"),
    )


def first_hits(gold: DataFrame, ranked: DataFrame) -> DataFrame:
    """For each question its first rank with the right source and span, and the first with the right source.

    ``ranked`` is (question_id, rank, source_id, text); questions without results keep their row.
    """
    right = F.col("source_id") == F.col("expected_source_id")
    hit = right & (F.instr(F.lower("text"), F.lower("answer_span")) > 0)
    return gold.join(ranked, F.col("id") == F.col("question_id"), "left").groupBy("id").agg(
        F.min(F.when(hit, F.col("rank"))).alias("rank"), F.min(F.when(right, F.col("rank"))).alias("scheme_rank"), F.count("rank").alias("n_results")
    )


def reason(expected_slug: Column, detected_slug: Column) -> Column:
    """Why a question missed, the first cause that holds; null for a hit."""
    return (
        F.when(F.col("rank").isNotNull(), None)
        .when(detected_slug.isNotNull() & (detected_slug != expected_slug), "filter_chose_wrong_scheme")
        .when(F.col("n_results") == 0, "nothing_above_floor")
        .when(F.col("scheme_rank").isNull(), "scheme_absent")
        .otherwise("span_absent")
    )


def scores(outcomes: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 6)) -> DataFrame:
    """Share of questions hit within k, of the right source within k, and mean reciprocal rank; zeros for none."""
    share = lambda c, k: F.round(F.coalesce(F.avg(F.when(F.col(c) <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 6)
    return outcomes.agg(
        F.count("*").alias("n_questions"),
        *(share("rank", k).alias(f"hit_at_{k}") for k in ks),
        *(share("scheme_rank", k).alias(f"scheme_at_{k}") for k in ks),
        F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )


def grid_order(cap: int) -> list[Column]:
    return [(F.col("max_tokens") > cap).cast("int").asc(), F.desc("recall_at_5"), F.asc("n_chunks"), F.asc("mean_chars"), F.asc("cell_no")]


def grid_winner(cells: DataFrame, cap: int = 256) -> DataFrame:
    """The best cell that was not skipped; ties keep the order of the grid."""
    return cells.where(~F.col("skipped")).orderBy(*grid_order(cap)).limit(1)


def best_per_strategy(cells: DataFrame, cap: int = 256) -> DataFrame:
    order = [c for i, c in enumerate(grid_order(cap)) if i != 3]
    w = Window.partitionBy("strategy").orderBy(*order)
    return cells.where(~F.col("skipped")).withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def newest(stamp: str) -> Column:
    """The greatest time as text, blanks apart; empty if there is none."""
    return F.coalesce(F.max(F.nullif(F.col(stamp), F.lit(""))), F.lit(""))
