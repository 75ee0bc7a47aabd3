"""Filling containers of fixed capacity with items of varying length.

Harmonic packing: lengths are divided into classes by reciprocals of the capacity, class k being those of which k fit
but not k + 1 of its longest (capacity / (k + 1) < length <= capacity / k). A container is opened for a class and takes
exactly k of its items, whichever they are; the class's last container takes those that are left. Plain harmonic packing
leaves the rest of the container empty; here the room that is left is given to smaller classes, longest lengths first.
How many containers of each composition there are is planned on the histogram of lengths, which has at most ``capacity``
entries, so the plan does not depend on the order of the items.

Items are dealt by hash into shards of bounded expected size, and every shard is packed on its own by one task, with
ids and lengths only. Rows that repeat are counted first and dealt out one by one, so no id is a hot key, and the result
is the same however the input was divided. The last containers of a shard may stay part empty, a few among thousands.

Defined results: an item longer than the capacity is cut into full containers and one rest, which is packed as any
item; an item of length 0 (null or empty text) has one row without a container; each row of the input is packed, also
if an id repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Tokens that a container holds, and expected items of a shard.
CAPACITY = 4096
SHARD = 25_000


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Compositions as (number of containers, [(length, items in each container)])."""
    left = histogram.copy()
    below = np.arange(-1, capacity)  # a length at or under which to look, with path compression

    def longest(at_most: int) -> int:
        path = []
        while at_most > 0 and not left[at_most]:
            path.append(at_most)
            at_most = int(below[at_most])
        for p in path:
            below[p] = at_most
        return at_most

    out = []
    while (top := longest(capacity)) > 0:
        k = capacity // top
        least = capacity // (k + 1)  # lengths over it are of the class
        parts, room, size, wanted = [], capacity, top, k
        while size > least and wanted:  # k items of the class
            n = min(wanted, int(left[size]))
            parts.append((size, n))
            room -= n * size
            wanted -= n
            size = longest(size - 1)
        size = longest(min(least, room))
        while room > 0 and size > 0:  # what is left goes to smaller classes
            n = min(room // size, int(left[size]))
            parts.append((size, n))
            room -= n * size
            size = longest(min(size - 1, room))
        times = min(int(left[size]) // n for size, n in parts)
        for size, n in parts:
            left[size] -= times * n
        out.append((times, parts))
    return out


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item (all lengths from 1 to capacity), and the number of containers."""
    order = np.argsort(-lengths, kind="stable")
    first = {}
    histogram = np.bincount(lengths, minlength=capacity + 1)
    at = 0
    for size in np.flatnonzero(histogram)[::-1].tolist():
        first[size] = at
        at += int(histogram[size])
    container = np.empty(len(lengths), np.int64)
    used = 0
    for times, parts in plan(histogram, capacity):
        for size, n in parts:
            a = first[size]
            container[order[a : a + times * n]] = used + np.arange(times * n) // n
            first[size] = a + times * n
        used += times
    return container, used


def pack_items(items: DataFrame, item: str = "doc_id", length: str = "n_tokens", capacity: int = CAPACITY, shard: int = SHARD, n_items: int | None = None) -> DataFrame:
    """(item, piece_no, token_start, n_tokens, container_id) of every item; ``n_items`` saves a count."""
    shards = max(1, -(-(items.count() if n_items is None else n_items) // shard))
    alike = items.groupBy(F.col(item), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_length")).agg(F.count("*").alias("_n"))
    sized = alike.select(item, "_length", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy"))
    dealt = sized.withColumn("_shard", F.pmod(F.xxhash64(item, "_length", "_copy"), F.lit(shards)))
    schema = T.StructType([items.schema[item], *T.StructType.fromDDL("piece_no int, token_start long, n_tokens long, container_id long")])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([item, "_length", "_copy"], kind="stable")
        n = pdf["_length"].to_numpy().astype(np.int64)
        pieces = np.maximum(-(-n // capacity), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        size = np.minimum(n[row] - start, capacity)
        some = size > 0
        container = np.full(len(row), -1, np.int64)
        container[some], _ = pack(size[some], capacity)
        ids = pd.array(container + (int(pdf["_shard"].iloc[0]) << 40), dtype="Int64")
        ids[~some] = pd.NA
        return pd.DataFrame({item: pdf[item].to_numpy()[row], "piece_no": piece.astype(np.int32), "token_start": start, "n_tokens": size, "container_id": ids})

    return dealt.groupBy("_shard").applyInPandas(fill, schema)


def audit(items: DataFrame, packed: DataFrame, item: str = "doc_id", length: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: n_items, and how many containers hold too much, items lack tokens or have too many, or are cut in vain."""
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(F.col("container_id").isNotNull() & (F.col("n") > capacity))
    # both sides are summed by id before they meet
    needs = F.sum(F.greatest(F.ceil(F.coalesce(length, F.lit(0)) / capacity), F.lit(1))).alias("_pieces")
    whole = items.groupBy(item).agg(F.sum(F.coalesce(length, F.lit(0))).alias("_tokens"), needs, F.count("*").alias("_rows"))
    got = packed.groupBy(F.col(item).alias("_item")).agg(F.sum("n_tokens").alias("_packed"), F.count("*").alias("_got"))
    both = whole.join(got, F.col(item).eqNullSafe(F.col("_item")), "left")
    counts = both.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_items"),
        F.count_if(~F.col("_packed").eqNullSafe(F.col("_tokens"))).alias("n_wrong_tokens"),
        F.count_if(F.col("_got") > F.col("_pieces")).alias("n_cut_in_vain"),
        F.lit(0).cast("long").alias("n_overfull"),
    )
    zero = [F.lit(0).cast("long").alias(c) for c in counts.columns[:-1]]
    parts = counts.union(full.agg(F.count("*").alias("n_overfull")).select(*zero, "n_overfull"))
    return parts.agg(*(F.sum(c).alias(c) for c in counts.columns))
