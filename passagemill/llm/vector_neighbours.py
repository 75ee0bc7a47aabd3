"""The most similar vectors for every vector: multi-index hashing of learned binary codes, then exact scores.

Rotations are learned on a bounded sample (principal directions of equal variance, then iterative quantisation, which
turns them until the signs lose least), and the sign of each rotated coordinate is a bit of the code. The code is
divided into substrings of about log2(n / ``CROWD``) bits, and each substring is an index of its own: codes within
Hamming distance (substrings - 1) agree in at least one of them (pigeonhole) and meet there. How many substrings there
are is not fixed but planned for the collection: pairs right at the lowest score are made from the sample, and rotations
are added until the share of them that meets, and passes the filters after, reaches ``RECALL``. So recall at the floor
is the same for any number of vectors; what grows is the number of substrings, about as n to the power 1/3.

Where codes meet, pairs whose first words of code differ in more bits than those of pairs at the floor are passed over,
and the rest is scored with the vectors themselves. Codes travel to their meeting places packed, many in a row.

Equal vectors have one code; of such a group, the first ids by order stand for it, as many as can be anyone's
neighbours.

Defined results: vectors that are null, of another length, all zero or with a value that is not finite take no part;
rows with one id count once, with the greatest of their vectors (by the first ``HEAD`` numbers, then by hash value);
equal scores are ordered by id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passagemill.llm.runs import pairs_within
from passagemill.session import cut_lineage, written

K, MIN_SCORE, DIMENSION, HEAD = 5, 0.80, 384, 16
#: Share of the pairs right at the lowest score that must be scored.
RECALL = 0.96
#: Rows on which rotations are learned at most, rounds of learning, and pairs at the floor that are made from the sample.
SAMPLE, ROUNDS, MADE = 10_000, 8, 4_000
#: Vectors of a sample of which a fifth is kept apart for those pairs; of fewer, all are.
LEAST_APART = 100
#: Codes that share a value of a substring on average, if values are equally frequent.
CROWD = 64
#: Bits of one rotation at most; machine words of code that travel along and are compared.
TURN, WORDS = 256, 4
#: Deviations by which a pair may have more differing bits than those at the floor have: in the first word, in all.
SLACK = (4.0, 3.5)
#: Codes that one task compares in one place; a fuller place is divided into blocks, and its pairs of blocks are spread.
PLACE = 20_000
#: Bytes of packed codes in a partition, about.
PACKED = 16 << 20


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (dimension, bits) projection whose signs are the code of a vector.

    The principal directions are scaled to equal variance before they are turned: else the few directions that tell the
    large clusters apart rule all bits, the codes of a cluster agree in most parts, and its vectors all meet.
    """
    n, dimension = sample.shape
    if not n:
        return np.zeros(dimension), np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, bits)))[0]
    mean = sample.mean(0)
    centred = sample - mean
    spread, directions = np.linalg.eigh(centred.T @ centred / n)
    spread = (n * spread + dimension * spread.mean()) / (n + dimension)  # few vectors say little of single directions
    top = directions[:, ::-1][:, :bits] / np.sqrt(np.maximum(spread[::-1][:bits], max(spread[-1], 1e-12) * 1e-3))
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    flat = centred @ top
    for _ in range(rounds if len(sample) > bits else 0):
        u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat)
        turn = (u @ vt).T
    return mean, top @ turn


@dataclass
class Plan:
    """Codes of ``parts`` substrings of ``width`` bits, ``per_word`` in each machine word."""

    width: int
    per_word: int
    parts: int
    mean: np.ndarray
    learned: np.ndarray  # (dimension, bits), the bits of whole words
    most: tuple[int, int]  # differing bits that are let pass: in the first word, in the first WORDS words
    recall: float  # of pairs at the floor, as far as measured on pairs of the sample

    def words(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, machine words) of code."""
        bit = ((unit - self.mean).astype(np.float32) @ self.learned > 0).reshape(len(unit), -1, self.per_word * self.width)
        padded = np.zeros((*bit.shape[:2], 64), bool)
        padded[:, :, : bit.shape[2]] = bit
        return np.packbits(padded, axis=2, bitorder="little").view(np.uint64)[:, :, 0]

    def values(self, words: np.ndarray) -> np.ndarray:
        """(vectors, parts) values of the substrings."""
        shifts = (np.arange(self.per_word) * self.width).astype(np.uint64)
        every = words[:, :, None] >> shifts & np.uint64((1 << self.width) - 1)
        return every.reshape(len(words), -1)[:, : self.parts]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def at_floor(sample: np.ndarray, score: float, n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of exactly this cosine, of unit vectors of the sample: moved in any direction, and towards one another."""
    rng = np.random.default_rng(seed)
    x, out = sample[rng.integers(len(sample), size=n)], []
    for away in (rng.normal(size=x.shape), sample[rng.integers(len(sample), size=n)] + rng.normal(size=x.shape) * 1e-6):
        away = unit(away - (away * x).sum(1, keepdims=True) * x)
        out.append((x, score * x + np.sqrt(1 - score * score) * away))
    return out


def meeting(plan: Plan, a: np.ndarray, b: np.ndarray, parts: int | None = None) -> np.ndarray:
    """Which pairs of unit vectors are scored: those that meet and pass the filters."""
    u, v = plan.words(a), plan.words(b)
    same = (plan.values(u) == plan.values(v))[:, :parts].any(1)
    differ = np.bitwise_count(u[:, :WORDS] ^ v[:, :WORDS]).astype(int)
    return same & (differ[:, 0] <= plan.most[0]) & (differ.sum(1) <= plan.most[1])


def make_plan(sample: np.ndarray, n: int, min_score: float = MIN_SCORE, recall: float = RECALL) -> Plan:
    """Codes for ``n`` vectors, learned on a sample of unit vectors: as many substrings as the recall needs."""
    dimension = sample.shape[1]
    width = int(np.clip(np.round(np.log2(max(n, 2) / CROWD)), 4, 30))
    per_word = min(64, TURN // WORDS, max(dimension // WORDS, width)) // width
    bits = WORDS * per_word * width
    if bits > dimension:
        raise ValueError("more bits than dimensions")
    plan = Plan(width, per_word, WORDS * per_word, np.zeros(dimension), np.zeros((dimension, 0), np.float32), (64, 64 * WORDS), 1.0)
    # pairs are made from vectors that the rotations have not seen; of few vectors nothing is learned
    apart = np.arange(len(sample)) % 5 == 0 if len(sample) >= LEAST_APART else np.ones(len(sample), bool)
    pairs = at_floor(sample[apart], min_score, MADE, 7) if len(sample) else []
    met = [np.zeros(0, bool) for _ in pairs]
    turns: list[np.ndarray] = []
    while True:
        plan.mean, learned = learn_rotation(sample[~apart], bits, seed=5 + len(turns))
        turns.append(learned.astype(np.float32))
        one = Plan(width, per_word, WORDS * per_word, plan.mean, turns[-1], plan.most, 1.0)
        same = [one.values(one.words(a)) == one.values(one.words(b)) for a, b in pairs]
        if len(turns) == 1:
            differ = [np.bitwise_count(one.words(a) ^ one.words(b)).astype(int) for a, b in pairs]
            first, total = ([f(d) for d in differ] for f in (lambda d: d[:, 0], lambda d: d.sum(1)))
            plan.most = tuple(int(np.ceil(max((d.mean() + slack * d.std() for d in ds), default=64))) for ds, slack in zip((first, total), SLACK))
            passed = [(f <= plan.most[0]) & (t <= plan.most[1]) for f, t in zip(first, total)]
            met = [np.zeros(len(d), bool) for d in differ]
        for part in range(WORDS * per_word):
            met = [m | s[:, part] for m, s in zip(met, same)]
            plan.recall = min((float((m & p).mean()) for m, p in zip(met, passed)), default=1.0)
            if plan.recall >= recall:
                plan.parts = (len(turns) - 1) * WORDS * per_word + part + 1
                plan.learned = np.concatenate(turns, axis=1)
                return plan


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def usable_vectors(df: DataFrame, item: str, vector: str, dimension: int = DIMENSION) -> DataFrame:
    """(item, vector) of the rows that take part."""
    schema = df.select(item, vector).schema

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimension)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            yield batch.filter(pa.array(ok))

    # a null inside a vector is no number; the array's size is checked before its values
    sized = df.select(item, vector).where(F.col(item).isNotNull() & (F.size(vector) == dimension) & ~F.exists(vector, lambda v: v.isNull()))
    return sized.mapInArrow(usable, schema)


def _codes(vectors: DataFrame, plan: Plan, dimension: int) -> DataFrame:
    """(id, code) of (id, vector), a row for each id."""
    shared = vectors.sparkSession.sparkContext.broadcast(plan)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                words = shared.value.words(unit(_matrix(part.column("vector"), dimension)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([w.tobytes() for w in words], pa.binary())], names=["id", "code"])

    return vectors.select("id", "vector").mapInArrow(encode, "id long, code binary").dropDuplicates(["id"])


_FILED = np.dtype([("place", np.int64), ("id", np.int64), ("words", np.uint64, WORDS)])


def _file(plan_words: int, width: int, per_word: int, parts: int, partitions: int):
    """Rows (part, packed) of codes: what is filed under the places of a partition, packed."""
    shape = Plan(width, per_word, parts, np.zeros(0), np.zeros((0, 0)), (0, 0), 0.0)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            words = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint64).reshape(n, plan_words)
            filed = np.empty(n * parts, _FILED)
            place = (np.arange(parts, dtype=np.int64) << width) + shape.values(words).astype(np.int64)
            filed["place"], filed["id"] = place.ravel(), np.repeat(batch.column("id").to_numpy(), parts)
            filed["words"] = np.repeat(words[:, :WORDS], parts, axis=0)
            of = (filed["place"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(partitions)
            order = np.argsort(of, kind="stable")
            filed, of = filed[order], of[order]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            packed = [x.tobytes() for x in np.split(filed, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(of[first].astype(np.int64)), pa.array(packed, pa.binary())], names=["part", "packed"])

    return file


class _Pairs:
    """Compares codes that meet."""

    def __init__(self, width: int, per_word: int, parts: int, most: tuple[int, int]):
        self.width, self.per_word, self.parts, self.most = width, per_word, parts, most

    def near(self, filed: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b), a < b, of the pairs of rows that are near enough and have not met in an earlier substring."""
        words = filed["words"]
        first = np.ascontiguousarray(words[:, 0])
        ok = np.bitwise_count(first[i] ^ first[j]) <= self.most[0]
        i, j = i[ok], j[ok]
        differ = words[i] ^ words[j]
        ok = np.bitwise_count(differ).sum(1, dtype=np.int16) <= self.most[1]
        i, j, differ = i[ok], j[ok], differ[ok]
        part = filed["place"][i] >> self.width
        met = np.zeros(len(i), bool)
        mask = np.uint64((1 << self.width) - 1)
        for n in range(min(self.parts, WORDS * self.per_word)):
            same = differ[:, n // self.per_word] >> np.uint64(n % self.per_word * self.width) & mask == 0
            met |= same & (n < part)
        a, b = filed["id"][i[~met]], filed["id"][j[~met]]
        keep = a != b
        return np.minimum(a, b)[keep], np.maximum(a, b)[keep]


_MET = "a long, b long, meeting long, packed binary"


def _met(a: np.ndarray, b: np.ndarray, meeting: np.ndarray | None = None, packed: list[bytes] | None = None) -> pa.RecordBatch:
    none = [None] * len(a)
    columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(none if meeting is None else meeting, pa.int64()), pa.array(none if packed is None else packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "meeting", "packed"])


def _gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[bytes]]]:
    """The packed values of each run of equal keys of a sorted partition."""
    held, of = [], None
    for batch in batches:
        for k, packed in zip(batch.column(key).to_pylist(), batch.column("packed").to_pylist()):
            if k != of and held:
                yield of, held
                held = []
            of = k
            held.append(packed)
    if held:
        yield of, held


def _meet(pairs: _Pairs, place: int):
    """Near pairs of what is filed; overfull places come out as pairs of their blocks, packed."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in _gathered(batches, "part"):
            filed = np.frombuffer(b"".join(packed), _FILED)
            filed = filed[np.argsort(filed["place"], kind="stable")]
            first = np.flatnonzero(np.r_[True, filed["place"][1:] != filed["place"][:-1]])
            size = np.diff(np.r_[first, len(filed)])
            for at, n in zip(first[size > place].tolist(), size[size > place].tolist()):
                rows, blocks = filed[at : at + n], -(-n // place)
                block = (rows["id"].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(40)) % np.uint64(blocks)
                for x in range(blocks):
                    own = rows[block == x].tobytes()
                    for y in range(blocks):
                        low, high = min(x, y), max(x, y)
                        key = (int(rows["place"][0]) * 0x9E3779B97F4A7C15 + (low << 20) + high) % (1 << 63)
                        yield _met(np.zeros(0), np.zeros(0)) if not own else pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([key], pa.int64()), pa.array([own], pa.binary())], names=["a", "b", "meeting", "packed"])
            filed = filed[np.repeat(size <= place, size)]
            for i, j in pairs_within(filed["place"], 2_000_000):
                yield _met(*pairs.near(filed, i, j))

    return meet


def _meet_blocks(pairs: _Pairs):
    """Near pairs of the blocks of overfull places: of one block with itself, or of two with one another."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in _gathered(batches, "meeting"):
            filed = np.frombuffer(b"".join(packed), _FILED)
            n = len(packed[0]) // _FILED.itemsize if len(packed) > 1 else 0
            rows = np.arange(len(filed))
            for at in range(0, n or len(filed), step := max(1, 2_000_000 // max(1, len(filed)))):
                i = np.arange(at, min(at + step, n or len(filed)))
                i, j = (x.ravel() for x in np.meshgrid(i, rows[n:], indexing="ij"))
                if not n:
                    i, j = i[i < j], j[i < j]
                yield _met(*pairs.near(filed, i, j))

    return meet


def _near_pairs(codes: DataFrame, plan: Plan, n: int, place: int) -> DataFrame:
    """(a, b), a < b: ids whose codes meet and are near, each pair once."""
    spark = codes.sparkSession
    partitions = max(spark.sparkContext.defaultParallelism, -(-n * plan.parts * _FILED.itemsize // PACKED))
    pairs = _Pairs(plan.width, plan.per_word, plan.parts, plan.most)
    words = plan.learned.shape[1] // (plan.per_word * plan.width)
    filed = codes.mapInArrow(_file(words, plan.width, plan.per_word, plan.parts, 4 * partitions), "part long, packed binary")
    met = cut_lineage(filed.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_meet(pairs, place), _MET))
    blocks = met.where("packed is not null").select("meeting", "packed")
    out = met.where("a is not null").select("a", "b")
    if not blocks.isEmpty():
        out = out.union(blocks.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_meet_blocks(pairs), _MET).select("a", "b"))
    return out.distinct()


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x, y = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64) for c in ("x", "y"))
            score = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(score)], names=["a", "b", "score"])


def neighbours(df: DataFrame, item: str, vector: str, k: int = K, min_score: float = MIN_SCORE, dimension: int = DIMENSION, sample: int = SAMPLE, place: int = PLACE, recall: float = RECALL) -> DataFrame:
    """(item, neighbour, score, rank): for each item its ``k`` others of highest cosine, if of at least ``min_score``."""
    usable = usable_vectors(df, item, vector, dimension).select(F.col(item).alias("item"), F.col(vector).alias("vector"))
    table = written(usable.select("item", F.xxhash64("vector").alias("id"), F.slice("vector", 1, HEAD).alias("head"), "vector"))
    rows = cut_lineage(table.groupBy("item").agg(F.max(F.struct("head", "id")).alias("best")).select("item", "best.id"))
    # of equal vectors, the k + 1 first ids are all that can be among anyone's k neighbours
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("item"))).where(F.col("nth") <= k + 1)
    ids = rows.select("id").distinct()
    n, upto = ids.count(), ids.orderBy("id").limit(sample).agg(F.max("id")).first()[0]
    if n:  # ids are hash values: the least are a sample
        picked = table.where(F.col("id") <= upto).groupBy("id").agg(F.first("vector").alias("vector")).orderBy("id").select("vector").toArrow()["vector"].combine_chunks()
        known = unit(_matrix(picked, dimension))
    else:
        known = np.zeros((0, dimension))
    plan = make_plan(known, n, min_score, recall)
    codes = cut_lineage(_codes(table, plan, dimension).join(ids, "id", "left_semi"))
    near = cut_lineage(_near_pairs(codes, plan, n, place))
    distinct = table.groupBy("id").agg(F.first("vector").alias("vector"))
    x, y = (distinct.select(F.col("id").alias(i), F.col("vector").alias(v)) for i, v in ("ax", "by"))
    scored = near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_scores, "a long, b long, score double")
    scored = cut_lineage(scored.where(F.col("score") >= min_score))
    both = scored.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").union(scored.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    # at most k other groups can hold a neighbour, ties apart; ids decide between these
    ranked = both.withColumn("nth", F.rank().over(Window.partitionBy("id").orderBy(F.desc("score")))).where(F.col("nth") <= k).select("id", "other", "score")
    around = ranked.union(ids.select("id", F.col("id").alias("other"), F.lit(1.0).alias("score")))
    named = around.join(first.select(F.col("id").alias("other"), F.col("item").alias("neighbour")), "other").select("id", "neighbour", "score")
    # one list for a group of equal vectors, long enough that each member may leave itself out
    order = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    lists = named.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).select("id", "neighbour", "score")
    each = rows.select("id", "item").join(lists, "id").where(F.col("item") != F.col("neighbour"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "neighbour"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item), "neighbour", "score", "rank")


def neighbour_pairs(found: DataFrame, item: str) -> DataFrame:
    """(item_a, item_b), item_a < item_b: pairs of which either is a neighbour of the other."""
    return found.select(F.least(item, "neighbour").alias(f"{item}_a"), F.greatest(item, "neighbour").alias(f"{item}_b")).distinct()
