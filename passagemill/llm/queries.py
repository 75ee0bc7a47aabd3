"""Queries of the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagemill.llm import encode, near_duplicates, packing, pii_sanitise, splitting, template_residue, token_budget, vector_neighbours
from passagemill.llm.sql import SQL  # noqa: F401
from passagemill.operators.snapshots import latest_rows
from passagemill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of personal information in the questions, by category and place."""
    return pii_sanitise.personal_information(table(spark, folder, "pii_probes")).select("id", "category", "start_at")


def p1_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """The questions with placeholders instead of personal information."""
    return pii_sanitise.sanitised(table(spark, folder, "pii_probes"))


def p2_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and tokens per source, language and domain of documents, per source, scheme and language of passages."""
    return token_budget.token_budget(table(spark, folder, "documents"), table(spark, folder, "chunk"))


def p2_document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document."""
    return encode.count_tokens(table(spark, folder, "documents"), ["doc_id"])


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_texts(table(spark, folder, "raw_doc"), ["raw_id"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of pages that are too long for one passage: those that the operator cut."""
    return _pieces(spark, folder).where("n_pieces > 1").select("raw_id", "section_no").distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All passages of all pages."""
    return _pieces(spark, folder)


def _last_passages(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    """Current rows of the last snapshot of ``chunk``."""
    chunk = table(spark, folder, "chunk")
    last = chunk.agg(F.max("snapshot_no").alias("snapshot_no"))
    rows = chunk.join(F.broadcast(last), "snapshot_no", "left_semi")
    return latest_rows(rows, ["chunk_id"], F.try_to_timestamp("fetched_at"), keep)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of current passages of the last snapshot that say nearly the same."""
    found = near_duplicates.near_duplicates(_last_passages(spark, folder, ["text"]), "chunk_id")
    return near_duplicates.near_duplicate_pairs(*found, "chunk_id")


def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Class, copies and links of each current passage of the last snapshot, those without words included."""
    passages = _last_passages(spark, folder, ["text"])
    found = near_duplicates.near_duplicates(passages, "chunk_id")
    return near_duplicates.near_duplicate_classes(*found, "chunk_id").unionByName(near_duplicates.classes_without_words(passages, "chunk_id"))


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """The same without the hash value that names a class."""
    return p5_classes(spark, folder).drop("class_id")


def doc_near_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that say nearly the same, wherever they are from."""
    found = near_duplicates.near_duplicates(table(spark, folder, "documents"), "doc_id")
    return near_duplicates.near_duplicate_pairs(*found, "doc_id")


def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vector_neighbours.neighbours(table(spark, folder, "chunk_vector"), "chunk_id", "embedding")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar ones of the other, at a cosine of 0.80 or more."""
    return vector_neighbours.neighbour_pairs(_neighbours(spark, folder), "chunk_id")


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The most similar other chunks of each chunk, with score and rank."""
    return _neighbours(spark, folder).withColumn("score", F.round("score", 6))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of each document."""
    return encode.encode_texts(table(spark, folder, "documents"), ["doc_id"])


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of 4,096 tokens."""
    documents = table(spark, folder, "documents")
    return packing.pack_items(encode.count_tokens(documents, ["doc_id"]), n_items=documents.count())


def p8_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Whether containers keep to their capacity and documents come out whole."""
    counted = encode.count_tokens(table(spark, folder, "documents"), ["doc_id"])
    return packing.audit(counted, p8_containers(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold template residue, stand-in copy, error messages or script notices in place of content."""
    return template_residue.residue(table(spark, folder, "documents")).select("doc_id")


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Those documents with the score of their most suspect sentence."""
    return template_residue.residue(table(spark, folder, "documents"))


def p9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """How the classifier does on sentences of hosts outside its fit, against their weak labels."""
    fitted = template_residue.train(table(spark, folder, "documents"))
    row = [(fitted.threshold, *(fitted.held_out[k] for k in ("sentences", "positives", "precision", "recall")))]
    return spark.createDataFrame(row, "threshold double, sentences double, positives double, precision double, recall double")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_sanitised, p2_token_budget, p2_document_tokens, p3_found, p3_pieces, p5_found, p5_classes, p5_links, doc_near_pairs, p6_found, p6_neighbours, p7_ids, p8_containers, p8_audit, p9_found, p9_scores, p9_quality)}
