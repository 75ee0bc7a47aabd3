"""Continuous ingest, an extension: pages that arrive in a folder become passages in the store.

The store is divided by a hash of the page into ``BUCKETS`` folders, and a batch rewrites those only to which its pages
belong. A page is a source_id with its url, closing slashes left out; of several versions the one fetched last counts,
within a batch and against the store, and a version without a usable fetched_at counts only where none has one. A batch
that is delivered again after a failure leaves the store as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill import schemas
from passagemill.operators import segmentation, store
from passagemill.operators.snapshots import latest_rows
from passagemill.session import cut_lineage
from passagemill.sources.files import exists, replace_folders, restore_folders

BUCKETS = 64


def _page() -> Column:
    return F.concat_ws("#", "source_id", store.bare_url(F.col("url")))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("page"), F.lit(BUCKETS)).cast("int")


def _passages(pages: DataFrame) -> DataFrame:
    return segmentation.passages(pages, key="page").withColumn("bucket", _bucket())


def read_store(spark: SparkSession, target: str) -> DataFrame:
    """The passages of the store, also where there are none."""
    empty = _passages(spark.createDataFrame([], schemas.RAW_DOC).withColumn("page", _page()))
    return spark.read.schema(empty.schema).parquet(target) if exists(spark, target) else empty


def upsert_pages(spark: SparkSession, batch: DataFrame, target: str) -> None:
    """Put the passages of the documents of ``batch`` (``schemas.RAW_DOC``) into the store at ``target``."""
    restore_folders(spark, target)
    rest = [c for c in batch.columns if c != "page"]
    pages = latest_rows(batch.where(F.col("source_id").isNotNull()).withColumn("page", _page()), ["page"], F.try_to_timestamp("fetched_at"), rest)
    pages = cut_lineage(pages.withColumn("bucket", _bucket()))
    touched = [r.bucket for r in pages.select("bucket").distinct().collect()]  # BUCKETS at most
    at = F.try_to_timestamp("fetched_at")
    old = read_store(spark, target).where(F.col("bucket").isin(touched))
    stored = old.groupBy("page").agg(F.max(at).alias("_stored"))
    pages = pages.join(stored, "page", "left").where(F.coalesce(at >= F.col("_stored"), F.isnull("_stored"))).drop("_stored", "bucket")
    # passages that a shorter version no longer has go with the old version
    kept = old.join(pages.select("page"), "page", "left_anti")
    replace_folders(kept.unionByName(_passages(pages)), target, "bucket", touched)


def ingest(spark: SparkSession, landing: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert the passages of every new document of ``landing`` (JSON lines) into the store at ``target``."""

    def load(batch: DataFrame, _: int) -> None:
        upsert_pages(spark, batch, target)

    stream = spark.readStream.schema(schemas.RAW_DOC).json(landing).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if available_now else stream.trigger(processingTime="30 seconds")).start()
