"""The passage store: metadata, idempotent upsert, orphans, allow-lists and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from passagemill.functions import text as X

METADATA = "chunk_id source_id scheme_name scheme_slug category plan url page_title heading_trail chunk_index char_len word_count content_hash fetched_at".split()
TRAIL = " > "
# Suffixes of hosts that are never a source.
DENIED_HOSTS = (
    "medium.com blogspot.com wordpress.com reddit.com quora.com youtube.com youtu.be wikipedia.org wikimedia.org linkedin.com twitter.com x.com facebook.com"
    " instagram.com substack.com tradingview.com moneycontrol.com etmoney.com zerodha.com"
).split()


def to_metadata(chunks: DataFrame) -> DataFrame:
    """Primitive, never-null metadata of passages; the trail is one string."""
    types = dict(chunks.dtypes)

    def flat(c: str) -> Column:
        if types[c].startswith("array"):
            return X.blank_if_null(F.array_join(c, TRAIL))
        return F.coalesce(F.col(c), F.lit(0).cast(types[c]) if types[c] in ("int", "bigint") else F.lit(""))

    return chunks.select("text", *(flat(c).alias(c) for c in METADATA))


def from_metadata(stored: DataFrame) -> DataFrame:
    """Passages again: the trail divided, the id and the text to encode derived, missing lengths counted."""
    trail = F.filter(F.split("heading_trail", TRAIL), lambda x: x != "")
    return stored.withColumns(
        {
            "heading_trail": trail,
            "chunk_id": X.hash16(F.col("source_id"), F.col("chunk_index").cast("string")),
            "char_len": F.when(F.col("char_len") > 0, F.col("char_len")).otherwise(F.length("text")),
            "word_count": F.when(F.col("word_count") > 0, F.col("word_count")).otherwise(X.word_count(F.col("text"))),
        }
    ).withColumn("embed_text", F.when(F.size("heading_trail") > 0, F.concat(F.array_join("heading_trail", TRAIL), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))


def upsert(stored: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored rows without those that come anew, and the new ones; the same batch again changes nothing."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Passages that have a vector; the others are skipped."""
    return chunks.join(vectors.select("chunk_id", "embedding"), "chunk_id")


def orphans(stored: DataFrame, current: DataFrame, key: str = "chunk_id") -> DataFrame:
    return stored.join(current.select(key), key, "left_anti")


def bare_url(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def allowed(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages whose url is on the list, but for closing slashes."""
    listed = sources.select(bare_url(F.col("url")).alias("_bare"))
    return pages.withColumn("_bare", bare_url(F.col("url"))).join(listed, "_bare", "left_semi").drop("_bare")


def is_denied(url: Column) -> Column:
    host = X.blank_if_null(F.lower(F.try_parse_url(url, F.lit("HOST"))))
    hit = F.lit(False)
    for suffix in DENIED_HOSTS:
        hit = hit | (host == suffix) | host.endswith("." + suffix)
    return hit


def replay(docs: DataFrame, sources: DataFrame, order: Column) -> tuple[DataFrame, DataFrame]:
    """(the last document of each source, the sources without any). A source is a source_id with its url."""
    keys = ["source_id", "_bare"]
    specs = sources.select("source_id", bare_url(F.col("url")).alias("_bare")).distinct()
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    kept = docs.withColumn("_bare", bare_url(F.col("url"))).join(specs, keys, "left_semi").withColumn("_no", last).where("_no = 1")
    return kept.drop("_no", "_bare"), specs.join(kept, keys, "left_anti").select("source_id")
