"""A batch of questions to answers: guards first, then search results, reply and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from passagemill.functions import rules as R, text as X
from passagemill.operators import guards as G, validate as V


def echo(hits: DataFrame, most: int = 3) -> Column:
    """The reply of the offline backend: the first sentences of the best hit, citing it; a refusal without hits."""
    top = F.try_element_at("hits", F.lit(1))
    none = F.size("hits") == 0
    return F.to_json(
        F.struct(
            F.when(none, "").otherwise(X.first_sentences(top["text"], most)).alias("answer"),
            F.when(none, F.array().cast("array<string>")).otherwise(F.array(top["url"])).alias("sources"),
            none.alias("refused"),
            F.when(none, "no_context").otherwise("").alias("reason"),
        )
    )


def context(hits: str = "hits") -> Column:
    """The blocks of a prompt, in order of rank."""
    block = lambda h: F.concat(F.lit("[Source "), h["rank"].cast("string"), F.lit("] "), h["url"], F.lit("\n"), h["text"])
    return F.array_join(F.transform(hits, block), "\n\n")


def answers(questions: DataFrame, hits: DataFrame, names: list[str], now: Column | None = None) -> DataFrame:
    """(id, kind, reason, answer, sources, last_updated) for questions (id, question) and their ranked hits
    (question_id, rank, text, url, fetched_at).

    Questions with identifiers or of another kind than factual never reach the join with the hits.
    """
    q = questions.withColumn("_pii", G.categories(G.identifiers(F.col("question")))).withColumn("_route", G.route(F.col("question"), names))
    early = (F.size("_pii") > 0) | (F.col("_route.kind") != "factual")
    kind = F.when(F.size("_pii") > 0, "pii_notice").otherwise(F.col("_route.kind"))
    notice = F.create_map(*(F.lit(x) for p in R.NOTICES.items() for x in p))
    none = F.array().cast("array<string>")
    stopped = q.where(early).select(
        "id",
        kind.alias("kind"),
        F.when(F.size("_pii") > 0, F.concat(F.lit("input_pii:"), F.array_join("_pii", ","))).otherwise(F.concat_ws(":", "_route.label", "_route.matched")).alias("reason"),
        F.element_at(notice, kind).alias("answer"),
        none.alias("sources"),
        F.lit("").alias("last_updated"),
    )
    asked = q.where(~early).select("id")
    safe, _ = G.split_safe(hits.join(asked.withColumnRenamed("id", "question_id"), "question_id", "left_semi"))
    listed = safe.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "url", "fetched_at", "text"))).alias("hits"))
    whole = asked.join(listed, F.col("id") == F.col("question_id"), "left").drop("question_id")
    found = whole.where(F.col("hits").isNotNull())
    done = V.validated(found.withColumn("raw", echo(found)), now).select("id", "kind", "reason", "answer", "sources", "last_updated")
    empty = whole.where(F.col("hits").isNull()).select("id", F.lit("abstain").alias("kind"), F.lit("nothing_retrieved").alias("reason"), F.lit(R.NOTICES["abstain"]).alias("answer"), none.alias("sources"), F.lit("").alias("last_updated"))
    return stopped.unionByName(done).unionByName(empty)
