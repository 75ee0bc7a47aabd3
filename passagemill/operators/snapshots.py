"""What changed between consecutive full snapshots of a table.

Every snapshot is summarised by one invertible Bloom lookup table (IBLT) per hash bucket of the record key. The tables
of two consecutive snapshots are subtracted cell by cell, the difference is peeled to (key hash, state hash) pairs,
buckets whose table was too small are retried with a larger one, and the recovered pairs are joined back to the
records, whose full keys and states verify them. The amount that is shuffled for the comparison follows the number of
cells, not the width of the records, and aggregation of the cells starts before the shuffle.

Defined results: a record without a state (no hash, no text) has the state of an empty text; a snapshot without any
record that counts does not exist; the first snapshot has no changes; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagemill.session import cut_lineage

HASHES = 3
#: Records per bucket at first, over all snapshots, and cells of each of the HASHES sub-tables.
RECORDS_PER_BUCKET = 1024
CELLS = 160
#: Each further round multiplies the cells of the buckets that failed; after the last, they are compared in full.
ENLARGE = 8
ROUNDS = 2

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxhash64_longs(*columns: np.ndarray, seed: int = 42) -> np.ndarray:
    """The value of Spark's ``xxhash64`` over columns of 64-bit integers, for arrays."""
    with np.errstate(over="ignore"):
        h = np.full(len(columns[0]), seed, np.uint64)
        for c in columns:
            h = h + _P5 + np.uint64(8)
            h ^= _rotl(c.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
            h = _rotl(h, 27) * _P1 + _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def latest_rows(df: DataFrame, keys: list[str], instant: Column, keep: list[str]) -> DataFrame:
    """The row of each key with the latest instant; equal instants are settled by the kept columns, largest first."""
    best = F.max(F.struct(instant.alias("_at"), *keep)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in keep))


def page_states(raw_doc: DataFrame) -> DataFrame:
    """(table_name, snapshot_no, record_key, state) of the current row of each page; failed fetches are ignored."""
    rows = raw_doc.where(F.col("http_status") == 200).select(
        "snapshot_no",
        F.regexp_replace("url", "/$", "").alias("record_key"),
        F.coalesce(F.lower("content_hash"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("state"),
        F.try_to_timestamp("fetched_at").alias("at"),
    )
    return _states("raw_doc", rows)


def passage_states(chunk: DataFrame) -> DataFrame:
    """As ``page_states``, for passages: the key is chunk_id, the stand-in hash has 16 digits."""
    rows = chunk.select(
        "snapshot_no",
        F.col("chunk_id").alias("record_key"),
        F.coalesce(F.lower("content_hash"), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16)).alias("state"),
        F.try_to_timestamp("fetched_at").alias("at"),
    )
    return _states("chunk", rows)


def _states(name: str, rows: DataFrame) -> DataFrame:
    rows = rows.where(F.col("record_key").isNotNull() & F.col("snapshot_no").isNotNull())
    return latest_rows(rows, ["snapshot_no", "record_key"], F.col("at"), ["state"]).select(
        F.lit(name).alias("table_name"), "snapshot_no", "record_key", "state"
    )


def _cell_of(key: Column, value: Column, i: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(key, value, F.lit(i).cast("long")), F.lit(cells)) + F.lit(i * cells)


def _peeler(cells: int):
    """Peel one bucket: repeatedly take every pure cell, and its pair out of the other cells that hold it."""

    def peel(pdf: pd.DataFrame) -> pd.DataFrame:
        n = HASHES * cells
        count, keys, values, checks = np.zeros(n, np.int64), *(np.zeros(n, np.int64) for _ in range(3))
        at = pdf["cell"].to_numpy()
        count[at], keys[at], values[at], checks[at] = (pdf[c].to_numpy() for c in ("n", "keys", "vals", "checks"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(n + 1):
            pure = np.flatnonzero(np.abs(count) == 1)
            pure = pure[xxhash64_longs(keys[pure], values[pure]) == checks[pure]]
            if not len(pure):
                break
            pairs = np.unique(np.stack([keys[pure], values[pure], count[pure]]), axis=1)
            k, v, s = pairs
            c = xxhash64_longs(k, v)
            for i in range(HASHES):
                cell = xxhash64_longs(k, v, np.full(len(k), i, np.int64)) % cells + i * cells
                np.subtract.at(count, cell, s)
                np.bitwise_xor.at(keys, cell, k)
                np.bitwise_xor.at(values, cell, v)
                np.bitwise_xor.at(checks, cell, c)
            found.append((k, v, s))
        head = [pdf["table_name"].iloc[0], pdf["seq"].iloc[0], pdf["bucket"].iloc[0]]
        if count.any() or keys.any() or values.any() or checks.any():
            return pd.DataFrame([[*head, False, 0, 0, 0]], columns=_PEELED)
        if not found:
            return pd.DataFrame(columns=_PEELED)
        k, v, s = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame(dict(zip(_PEELED, [*([x] * len(k) for x in head), True, k, v, s])))

    return peel


_PEELED = ["table_name", "seq", "bucket", "ok", "key64", "val64", "sign"]
_PEELED_TYPES = "table_name string, seq int, bucket long, ok boolean, key64 long, val64 long, sign long"


def _difference(records: DataFrame, cells: int, only: DataFrame | None = None) -> DataFrame:
    """Subtracted and peeled tables of all buckets of ``records``, which carry ``last``, the last snapshot's number.

    ``only`` names the buckets wanted. A record takes part in the pair of its own snapshot and in the next one, so the
    records that are left for a failed pair also leave half-filled tables of its neighbours, which must not be peeled.
    """
    sides = F.explode(
        F.filter(
            F.array(
                F.struct(F.col("seq").alias("pair"), F.lit(1).cast("long").alias("sign")),
                F.struct((F.col("seq") + 1).alias("pair"), F.lit(-1).cast("long").alias("sign")),
            ),
            lambda s: (s["pair"] > 1) & (s["pair"] <= F.col("last")),
        )
    )
    cell = F.explode(F.array(*(_cell_of(F.col("key64"), F.col("val64"), i, cells) for i in range(HASHES))))
    sketch = (
        records.select("table_name", "bucket", "key64", "val64", sides.alias("side"))
        .select("table_name", "bucket", "key64", "val64", F.col("side.pair").alias("seq"), F.col("side.sign").alias("sign"))
        .select("*", cell.alias("cell"))
        .groupBy("table_name", "seq", "bucket", "cell")
        .agg(
            F.sum("sign").alias("n"),
            F.bit_xor("key64").alias("keys"),
            F.bit_xor("val64").alias("vals"),
            F.bit_xor(F.xxhash64("key64", "val64")).alias("checks"),
        )
        .where("n <> 0 or keys <> 0 or vals <> 0")
    )
    if only is not None:
        sketch = sketch.join(only, ["table_name", "seq", "bucket"], "left_semi")
    return sketch.groupBy("table_name", "seq", "bucket").applyInPandas(_peeler(cells), _PEELED_TYPES)


def snapshot_changes(states: DataFrame, cells: int = CELLS, records_per_bucket: int = RECORDS_PER_BUCKET) -> DataFrame:
    """(table_name, snapshot_no, record_key, change_kind) for each snapshot after the first of each table.

    ``states`` has one row per (table_name, snapshot_no, record_key), with its state.
    """
    order = Window.partitionBy("table_name").orderBy("snapshot_no")
    states = cut_lineage(
        states.select(
            "table_name", "snapshot_no", "record_key", "state", F.xxhash64("record_key").alias("key64"), F.xxhash64("state").alias("val64")
        )
    )
    numbered = states.select("table_name", "snapshot_no").distinct().select(
        "table_name",
        "snapshot_no",
        F.row_number().over(order).alias("seq"),
        F.count("*").over(Window.partitionBy("table_name")).cast("int").alias("last"),
    )
    buckets = max(1, -(-states.count() // records_per_bucket))
    records = states.join(F.broadcast(numbered), ["table_name", "snapshot_no"]).withColumn(
        "bucket", F.pmod(F.xxhash64("key64", F.lit(7)), F.lit(buckets))
    )
    todo, failed, pairs = records, None, None
    for round_no in range(ROUNDS):
        peeled = cut_lineage(_difference(todo, cells * ENLARGE**round_no, failed))
        found = peeled.where("ok").drop("ok", "bucket")
        pairs = found if pairs is None else pairs.union(found)
        failed = peeled.where("not ok").select("table_name", "seq", "bucket")
        if failed.isEmpty():
            break
        # records of the later snapshot of a failed pair, and of the one before it
        both = failed.union(failed.select("table_name", (F.col("seq") - 1).alias("seq"), "bucket")).distinct()
        todo = records.join(both, ["table_name", "seq", "bucket"], "left_semi")
    else:
        pairs = pairs.unionByName(_compare_in_full(todo, failed))
    side = pairs.select(
        "table_name",
        F.col("seq").alias("pair"),
        F.when(F.col("sign") > 0, F.col("seq")).otherwise(F.col("seq") - 1).alias("seq"),
        "key64",
        "val64",
        "sign",
    ).distinct()
    verified = records.select("table_name", "seq", "key64", "val64", "record_key", "state").join(
        side, ["table_name", "seq", "key64", "val64"]
    )
    names = numbered.select("table_name", F.col("seq").alias("pair"), "snapshot_no")
    return (
        verified.groupBy("table_name", "pair", "record_key")
        .agg(
            F.max(F.when(F.col("sign") > 0, F.col("state"))).alias("new"),
            F.max(F.when(F.col("sign") < 0, F.col("state"))).alias("old"),
        )
        .where(~F.col("new").eqNullSafe(F.col("old")))
        .join(F.broadcast(names), ["table_name", "pair"])
        .select(
            "table_name",
            "snapshot_no",
            "record_key",
            F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change_kind"),
        )
    )


def _compare_in_full(records: DataFrame, failed: DataFrame) -> DataFrame:
    """The differing pairs of buckets whose tables could not be peeled even when enlarged."""
    new = records.join(failed, ["table_name", "seq", "bucket"], "left_semi").select("table_name", "seq", "key64", "val64")
    before = failed.select("table_name", (F.col("seq") - 1).alias("seq"), "bucket")
    old = records.join(before, ["table_name", "seq", "bucket"], "left_semi").select(
        "table_name", (F.col("seq") + 1).alias("seq"), "key64", "val64"
    )
    both = new.withColumn("sign", F.lit(1).cast("long")).union(old.withColumn("sign", F.lit(-1).cast("long")))
    return (
        both.groupBy("table_name", "seq", "key64", "val64")
        .agg(F.sum("sign").alias("sign"))
        .where("sign <> 0")
        .select("table_name", "seq", "key64", "val64", "sign")
    )
