"""Texts that are nearly the same: a chosen-path similarity join of their word sets.

A run of the join sends every set down one path. At each node of the path one word of the set is sampled, by hash
values that all sets in the node share, so two sets of similarity s go on together with probability s. Nodes of more
than ``BUCKET`` sets are split further as a DataFrame; smaller ones go to one task each, which goes on splitting, with
two samples per node, until at most ``SMALL`` sets are left, and compares those in full. ``RUNS`` independent runs are
made, as many as ``runs_needed`` says for the depth to which nodes had to be split. A node that hardly gets smaller by
being split holds sets that are mostly alike; it is compared in full, in pairs of blocks that go to different tasks.
Every pair that comes out has passed an exact comparison of the two sets.

Texts with the same words are joined as one set beforehand and come out again as copies, so that a group of copies of
any size costs one set in the join.

Defined results: a text without words (null, empty, signs only) is near no other text; ids are compared as they are;
repeated rows count once; extra columns are ignored; empty tables give no rows. Word sets are compared as 32-bit hash
values of their words, which takes two different words for one with a chance of about one in four thousand million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from passagemill.llm.runs import pairs_within, whole_runs
from passagemill.session import cut_lineage

THRESHOLD = 0.8
#: Share of the pairs right at the threshold that must be found; runs that are made at least.
RECALL, RUNS = 0.999, 11
#: Sets of a node that one task takes; sets that are compared in full; samples of a node within a task.
BUCKET, SMALL, BRANCHES = 16_384, 24, 2
#: Nodes of a path that are computed at once, and in all; past these, a node is compared in full whatever its size.
LEVELS, DEEPEST = 4, 48
#: Levels that a task adds at most before it compares all that is left of a node. Sets that are all alike don't part and
#: would only be multiplied by further levels.
INNER = 5
#: Copies of a block of a class.
COPIES = 2_048
#: Pairs that a task holds before it hands them on.
HELD = 100_000
#: Bits of a sketch, two machine words, and how many must agree: five deviations under the mean at the threshold.
SKETCH = 128
_U = np.uint64


def words(text: Column) -> Column:
    """Distinct words of a text: what is left of its lower-case form when all but letters, marks and digits separates."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""))


def runs_needed(depth: int, similarity: float = THRESHOLD, recall: float = RECALL) -> int:
    """Runs after which a pair of this similarity is found with this chance, if its nodes are split ``depth`` times as
    a DataFrame and INNER times in a task."""
    p = 1.0
    for _ in range(INNER):
        p = 1 - (1 - similarity * p) ** BRANCHES
    return int(np.ceil(np.log(1 - recall) / np.log(1 - p * similarity**depth)))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(32)
    return x


def _next_nodes(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The node that each set goes to from ``nodes``: that of its word with the least hash value there."""
    least = np.minimum.reduceat(_mix(tokens ^ np.repeat(nodes, sizes)), starts)
    return _mix(nodes + least)


def _sketches(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """One bit of each of SKETCH least hash values."""
    out = [np.zeros(len(starts), np.uint64) for _ in range(SKETCH // 64)]
    t = tokens.astype(np.uint32)
    with np.errstate(over="ignore"):
        for i, (a, b) in enumerate(np.random.default_rng(17).integers(1, 2**32, (SKETCH, 2), dtype=np.uint32) | np.uint32(1)):
            x = t * a
            x ^= x >> np.uint32(15)
            x *= b
            least = np.minimum.reduceat(x, starts)
            out[i // 64] |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64) << _U(i % 64)
    return out


def _ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and sizes of a list column."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], column.type)
    sizes = np.diff(array.offsets.to_numpy())
    return array.flatten().to_numpy(zero_copy_only=False), sizes


def _as_uint(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint32).astype(np.uint64)


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of sets with about ``most`` words."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _paths(sets: DataFrame, runs: range) -> DataFrame:
    """The next LEVELS nodes of each set (id, run, node, words); with ``runs``, the first ones of these."""
    schema = "id long, run int, " + ", ".join(f"p{i} long" for i in range(1, LEVELS + 1))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat = batch.column("id").to_numpy(), batch.column("words")
            tokens, sizes = _ragged(flat)
            tokens, offsets = _as_uint(tokens), np.r_[0, np.cumsum(sizes)]
            for part in _slices(sizes, 500_000):
                t, n = tokens[offsets[part.start] : offsets[part.stop]], sizes[part]
                starts = np.r_[0, np.cumsum(n)[:-1]]
                for run in runs or [None]:
                    if runs:
                        node = _mix(np.full(len(n), run + 1, np.uint64))
                        of = np.full(len(n), run, np.int32)
                    else:
                        node = batch.column("node").to_numpy()[part].view(np.uint64)
                        of = batch.column("run").to_numpy()[part]
                    path = []
                    for _ in range(LEVELS):
                        node = _next_nodes(t, starts, n, node)
                        path.append(node.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[part], of, *path)], names=["id", "run", *(f"p{i}" for i in range(1, LEVELS + 1))])

    return sets.mapInArrow(step, schema)


def _with_sketches(sets: DataFrame) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sizes = _ragged(batch.column("words"))
            tokens, offsets = _as_uint(tokens), np.r_[0, np.cumsum(sizes)]
            for part in _slices(sizes, 500_000):
                s = _sketches(tokens[offsets[part.start] : offsets[part.stop]], np.r_[0, np.cumsum(sizes[part])[:-1]])
                kept = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(x.view(np.int64)) for x in s)], names=[*kept.schema.names, "s0", "s1"])

    return sets.mapInArrow(sketch, "id long, words array<int>, s0 long, s1 long")


def _assign_nodes(sets: DataFrame, runs: range, bucket: int, threshold: float) -> tuple[DataFrame, int]:
    """(id, node, blocks) for each set and run, and how often nodes were split: the first node of its path that holds
    at most ``bucket`` sets, with blocks 0, or one that holds mostly equal ones, with the blocks to divide it into."""
    done, rows, depth, deepest = None, _paths(sets, runs), 0, 0
    while True:
        rows = cut_lineage(rows)
        heavy: list[DataFrame] = []
        for level in range(1, LEVELS + 1):
            p = f"p{level}"
            counted = (rows.join(heavy[-1], f"p{level - 1}", "left_semi") if heavy else rows).groupBy(p).agg(F.count("*").alias("n"), F.max("p1").alias("p1_"))
            heavier = cut_lineage(counted.where(F.col("n") > bucket))
            light = rows.join(heavier, p, "left_anti").select("id", F.col(p).alias("node"), F.lit(0).alias("blocks"))
            done = light if done is None else done.union(light)
            if heavier.isEmpty():
                return done, max(deepest, depth + level)
            rows = rows.join(heavier, p, "left_semi")
            heavy.append(heavier)
        depth += LEVELS
        first = heavy[0].select(F.col("p1").alias("p1_"), F.col("n").alias("n1"))
        alike = (F.col("n") > threshold ** (LEVELS - 1) * F.col("n1")) | F.lit(depth >= DEEPEST)
        dense = heavy[-1].join(first, "p1_").where(alike).select(p, F.ceil(F.col("n") / bucket).cast("int").alias("blocks"))
        dense = cut_lineage(dense)
        done = done.union(rows.join(dense, p).select("id", F.col(p).alias("node"), "blocks"))
        rows = rows.join(dense, p, "left_anti")
        deepest = depth
        rows = _paths(rows.select("id", "run", F.col(p).alias("node")).join(sets, "id").select("id", "words", "run", "node"), range(0))


def _meetings(nodes: DataFrame) -> DataFrame:
    """(meeting, id, block, across, whole) of (id, node, blocks): a task's node, or a pair of blocks of a dense one."""
    shared = nodes.where("blocks = 0").withColumn("n", F.count("*").over(Window.partitionBy("node"))).where("n > 1")
    plain = shared.select(F.col("node").alias("meeting"), "id", F.lit(0).alias("block"), F.lit(False).alias("across"), F.lit(False).alias("whole"))
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    dense = nodes.where("blocks > 0").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return plain.union(dense.select(key.alias("meeting"), "id", "block", (F.col("block") != F.col("other")).alias("across"), F.lit(True).alias("whole")))


def _joiner(threshold: float):
    agree = SKETCH * (1 + threshold) / 2
    agree -= 5 * np.sqrt(agree * (1 - agree / SKETCH))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "meeting", 8192):
            ids = table.column("id").to_numpy()
            flat, sizes = _ragged(table.column("words"))
            tokens, offsets = _as_uint(flat), np.r_[0, np.cumsum(sizes)]
            s0, s1 = (table.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1"))
            seen: set[tuple[int, int]] = set()

            def compare(rows: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
                out: list[tuple[int, int]] = []
                for i, j in pairs_within(key):
                    i, j = rows[i], rows[j]
                    ok = ~across[i] | (block[i] != block[j])
                    i, j = i[ok], j[ok]
                    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
                    ok = small >= threshold * large
                    i, j = i[ok], j[ok]
                    differ = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
                    ok = SKETCH - differ >= agree
                    for a, b in zip(i[ok].tolist(), j[ok].tolist()):
                        pair = (ids[a], ids[b]) if ids[a] < ids[b] else (ids[b], ids[a])
                        if pair in seen or pair[0] == pair[1]:
                            continue
                        if len(seen) >= 10 * HELD:
                            seen.clear()  # pairs may then come out again, which costs time and is undone by distinct()
                        seen.add(pair)
                        x, y = flat[offsets[a] : offsets[a + 1]], flat[offsets[b] : offsets[b + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                            out.append(pair)
                    if len(out) >= HELD:
                        yield _pairs(out)
                        out = []
                if out:
                    yield _pairs(out)

            block, across, whole = table.column("block").to_numpy(), np.asarray(table.column("across")), np.asarray(table.column("whole"))
            rows, nodes = np.arange(len(ids)), table.column("meeting").to_numpy().view(np.uint64)
            yield from compare(rows[whole], nodes[whole])
            rows, nodes = rows[~whole], nodes[~whole]
            for level in range(INNER + 1):
                order = np.argsort(nodes, kind="stable")
                rows, nodes = rows[order], nodes[order]
                first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
                of = np.diff(np.r_[first, len(nodes)])
                size = np.repeat(of, of)
                small = (size > 1) & (size <= SMALL) if level < INNER else size > 1
                yield from compare(rows[small], nodes[small])
                rows, nodes = rows[size > SMALL], nodes[size > SMALL]
                if not len(rows) or level == INNER:
                    break
                parts = []
                for part in _slices(sizes[rows], 500_000):
                    r, n = rows[part], sizes[rows[part]]
                    at = np.repeat(offsets[r] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    starts = np.r_[0, np.cumsum(n)[:-1]]
                    for branch in range(BRANCHES):
                        with np.errstate(over="ignore"):
                            seed = _mix(nodes[part] + _U(branch + 1))
                        parts.append((r, _next_nodes(tokens[at], starts, n, seed)))
                rows, nodes = (np.concatenate(x) for x in zip(*parts))

    return join


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(out, np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of ids whose sets (id long, words array<int>, distinct and not empty) are similar enough."""
    sets = cut_lineage(_with_sketches(sets))
    words_only = sets.select("id", "words")
    nodes, depth = _assign_nodes(words_only, range(RUNS), bucket, threshold)
    made = RUNS
    while (needed := runs_needed(depth, threshold, recall)) > made:
        more, further = _assign_nodes(words_only, range(made, needed), bucket, threshold)
        nodes, depth, made = nodes.union(more), max(depth, further), needed
    placed = _meetings(nodes).join(sets, "id").repartition("meeting").sortWithinPartitions("meeting")
    columns = placed.select("meeting", "id", "block", "across", "whole", "words", "s0", "s1")
    return columns.mapInArrow(_joiner(threshold), "a long, b long").distinct()


def near_duplicates(texts: DataFrame, item: str, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and membership of their copies.

    Returns (rep_a, rep_b), pairs of representatives, and (rep, item), one row for each item that has words, where rep
    is the class of all texts with the same words.
    """
    hashed = texts.select(item, F.transform(words(F.col(text)), lambda w: F.hash(w)).alias("words")).where(F.size("words") > 0)
    hashed = hashed.select(item, F.array_sort(F.array_distinct("words")).alias("words"))
    hashed = hashed.select(item, F.xxhash64("words").alias("rep"), "words")  # classes are 64-bit hash values
    hashed = cut_lineage(hashed)
    members = hashed.select("rep", item).distinct()
    chosen = hashed.groupBy("rep").agg(F.min(item).alias(item))
    sets = hashed.join(chosen, ["rep", item], "left_semi").dropDuplicates(["rep"]).select(F.col("rep").alias("id"), "words")
    links = similar_sets(sets, threshold, recall, bucket).select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"))
    return links, members


def near_duplicate_pairs(links: DataFrame, members: DataFrame, item: str) -> DataFrame:
    """All pairs of items, (item_a, item_b) with item_a < item_b, of linked texts and of copies."""
    a, b = (members.select(F.col("rep").alias(f"rep_{x}"), F.col(item).alias(x)) for x in "ab")
    linked = links.join(a, "rep_a").join(b, "rep_b")
    both = linked.select("a", "b").union(_copies(members, item))
    return both.select(F.least("a", "b").alias(f"{item}_a"), F.greatest("a", "b").alias(f"{item}_b")).distinct()


def _copies(members: DataFrame, item: str) -> DataFrame:
    """Pairs (a, b), a < b, of one class. Large classes are divided into blocks, whose pairs go to different tasks."""
    blocks = members.groupBy("rep").agg(F.ceil(F.count("*") / COPIES).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64(item, F.lit(3)), F.col("blocks")).cast("int")
    met = members.join(blocks, "rep").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rep", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", F.col(item).alias("id"))
    a, b = (met.select("rep", "low", "high", F.col("block").alias(f"block_{x}"), F.col("id").alias(x)) for x in "ab")
    once = (F.col("low") == F.col("high")) | (F.col("block_a") != F.col("block_b"))
    return a.join(b, ["rep", "low", "high"]).where(once & (F.col("a") < F.col("b"))).select("a", "b")


def near_duplicate_classes(links: DataFrame, members: DataFrame, item: str) -> DataFrame:
    """(item, class_id, n_copies, n_links): its class of equal word sets, items in it, and other classes linked to it."""
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    return (
        members.join(sizes, "rep")
        .join(ends, "rep", "left")
        .select(item, F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def classes_without_words(texts: DataFrame, item: str, text: str = "text") -> DataFrame:
    """Rows as those of ``near_duplicate_classes`` for the items whose texts have no words: each is its own class, without links."""
    without = ~F.coalesce(F.size(words(F.col(text))) > 0, F.lit(False))
    alone = texts.where(without).select(item).distinct()
    return alone.select(item, F.xxhash64(F.lit("no words"), F.col(item)).alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
