"""The grid of chunking settings: passages, budget, exact search and recall of each cell in one job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from passagemill.config import setting
from passagemill.functions import text as X
from passagemill.operators import segmentation as S, vectors as V
from passagemill.session import cut_lineage, spread

STRATEGIES, SIZES, OVERLAPS, TOP_K = ("recursive", "heading_bound", "semantic"), (400, 600, 800, 1000, 1200), (0.0, 0.10, 0.15), 5
#: Passages that are encoded and compared at once.
BLOCK = 4_000


def grid() -> list[tuple[int, str, int, float, int]]:
    """(cell_no, strategy, size, overlap, overlap in characters) of every cell."""
    cells = [(strategy, size, share, round(size * share)) for strategy in STRATEGIES for size in SIZES for share in OVERLAPS]
    return [(i, *c) for i, c in enumerate(cells)]


_OUT = "cell_no int, id string, score double, row_id string, hit boolean, tokens int, chunks long, chars long, rescued long, violations long"
_TYPES = pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()


def _estimate(text: str) -> int:
    """``text.token_estimate``: words between the white space that Spark knows, which is that of bytes."""
    return int(len(text.encode("utf-8", "surrogatepass").split()) * X.PIECES_PER_WORD) + X.SPECIAL_PIECES


def _enough(text: str) -> bool:
    return len(text.encode("utf-8", "surrogatepass").split()) >= setting("chunking.min_words")


class _Best:
    """The best passages of each cell for each question among those seen; ties by id."""

    def __init__(self, questions: list, n: int) -> None:
        self.questions, self.n = questions, n
        self.asked = self._unit([q.question for q in questions])
        self.held: dict[int, list[list[tuple[float, str, bool]]]] = {}
        self.waiting: dict[int, list[tuple[str, str, str, str]]] = {}
        self.size = 0

    @staticmethod
    def _unit(texts: list[str]) -> np.ndarray:
        x = V.hashing_vectors(texts).astype(np.float32).astype(np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def add(self, cell: int, row_id: str, source: str, text: str, encoded: str) -> None:
        self.waiting.setdefault(cell, []).append((row_id, source, text, encoded))
        self.size += 1
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        place = {e: i for i, e in enumerate(dict.fromkeys(e for rows in self.waiting.values() for *_, e in rows))}
        every = np.round(self.asked @ self._unit(list(place)).T, 6)
        for cell, rows in self.waiting.items():
            rows.sort()
            score = every[:, [place[e] for *_, e in rows]]
            held = self.held.setdefault(cell, [[] for _ in self.questions])
            least = np.array([-h[-1][0] if len(h) == self.n else -np.inf for h in held])
            for i in np.flatnonzero(score.max(axis=1) >= least):
                q = self.questions[i]
                for k in np.argsort(-score[i], kind="stable")[: self.n]:
                    row_id, source, text, _ = rows[k]
                    held[i].append((-score[i, k], row_id, q.answer_span is not None and source == q.expected_source_id and q.answer_span in text))
                held[i].sort()
                del held[i][self.n :]
        self.waiting, self.size = {}, 0

    def rows(self) -> Iterator[tuple]:
        self.flush()
        for cell, held in self.held.items():
            for q, best in zip(self.questions, held):
                yield from ((cell, q.id, -s, row_id, hit, None, None, None, None, None) for s, row_id, hit in best)


def _measured(docs: DataFrame, questions: list, settings: list[tuple[int, str, int, int]]) -> DataFrame:
    """Of each task: the best passages of each cell, how many have how many tokens and characters, counters of the
    budget. ``docs`` has key, page_source, trail and body of the sections in order; texts stay where they are."""
    cap, target = setting("chunking.max_wordpieces"), setting("chunking.target_wordpieces")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[pa.RecordBatch]:
        splits = [(cell, S.STRATEGIES[name](size, chars)) for cell, name, size, chars in settings]
        best, sizes, budget = _Best(questions, TOP_K), {}, {cell: [0, 0] for cell, *_ in settings}
        for batch in batches:
            for key, source, parts in zip(batch["key"], batch["page_source"], batch["parts"]):
                for cell, split in splits:
                    no = 0
                    for part in parts:
                        head = " > ".join(part["heading_trail"])
                        for text in filter(_enough, split(part["body"])):
                            encoded = f"{head}\n\n{text}" if head else text
                            kept = [text]
                            if _estimate(encoded) > cap:
                                kept, lost = S.rescue(text, cap, target)
                                budget[cell][0] += bool(kept)
                                budget[cell][1] += lost + (not kept)
                            for piece in kept:
                                row_id = hashlib.sha256(f"{key}:{no}".encode()).hexdigest()[:16]
                                best.add(cell, row_id, source, piece, f"{head}\n\n{piece}" if head else piece)
                                seen = sizes.setdefault((cell, _estimate(piece)), [0, 0])
                                seen[0] += 1
                                seen[1] += len(piece)
                                no += 1
        rows = [*best.rows(), *((c, None, None, None, None, t, n, chars, None, None) for (c, t), (n, chars) in sizes.items())]
        rows += [(c, None, None, None, None, None, None, None, *counts) for c, counts in budget.items()]
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, _TYPES)], names=[f.split()[0] for f in _OUT.split(", ")])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run({c: b.column(c).to_pylist() for c in b.schema.names} for b in batches)

    return docs.mapInArrow(batches_of, _OUT)


def sweep(docs: DataFrame, gold: DataFrame, cells: list[tuple[int, str, int, float, int]] | None = None, key: str = "source_id") -> DataFrame:
    """A row for each cell: size of its passages, counters of the budget, recall, and whether it was skipped.

    ``docs`` name the source that an answer must come from as page_source. Passages are those of ``passages`` and
    ``enforce_budget``. A cell without passages, or with texts that no split brings within the budget, is skipped. Cells
    that split alike are computed once. The gold questions are a closed list, labelled by hand.
    """
    spark, cells = docs.sparkSession, grid() if cells is None else cells
    alike = [S.alike(name, size, chars) for _, name, size, _, chars in cells]
    questions = gold.select(F.col("id").cast("string").alias("id"), "question", "expected_source_id", "answer_span").collect()
    trail = S.heading_trail(F.array("scheme_name"), F.array("page_title"), F.col("trail"))
    whole = S.sections(docs, key).join(docs.select(key, "page_source", "scheme_name", "page_title"), key)
    parts = F.array_sort(F.collect_list(F.struct("section_no", trail.alias("heading_trail"), "body")))
    whole = whole.groupBy(F.col(key).alias("key"), "page_source").agg(parts.alias("parts"))
    out = cut_lineage(_measured(spread(cut_lineage(whole)), questions, [(alike.index(a), *a) for a in dict.fromkeys(alike)]))
    rank = F.row_number().over(Window.partitionBy("cell_no", "id").orderBy(F.desc("score"), "row_id"))
    hits = out.where("id is not null").withColumn("rank", rank).where((F.col("rank") <= TOP_K) & F.col("hit")).groupBy("cell_no").agg(F.countDistinct("id").alias("_hits"))
    counts = out.where("tokens is not null").groupBy("cell_no", "tokens").agg(F.sum("chunks").alias("n"), F.sum("chars").alias("chars"))
    w = Window.partitionBy("cell_no")
    counts = counts.withColumn("n_chunks", F.sum("n").over(w)).withColumn("_upto", F.sum("n").over(w.orderBy("tokens")))
    sizes = counts.groupBy("cell_no", "n_chunks").agg(
        F.round(F.sum("chars") / F.sum("n"), 1).alias("mean_chars"), F.max("tokens").alias("max_tokens"), F.min(F.when(F.col("_upto") > F.bround(0.95 * (F.col("n_chunks") - 1), 0), F.col("tokens"))).alias("p95_tokens")
    )
    budget = out.where("rescued is not null").groupBy("cell_no").agg(F.sum("rescued").alias("rescued"), F.sum("violations").alias("violations"))
    done = budget.join(sizes, "cell_no", "left").join(hits, "cell_no", "left").withColumnRenamed("cell_no", "_as")
    names = spark.createDataFrame([(*c, alike.index(a)) for c, a in zip(cells, alike)], "cell_no int, strategy string, size int, overlap double, overlap_chars int, _as int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    skipped = F.col("n_chunks").isNull() | (F.coalesce("violations", F.lit(0)) > 0)
    recall = F.when(skipped, 0.0).otherwise(F.round(F.coalesce(F.col("_hits"), F.lit(0)) / max(1, len(questions)), 4))
    return names.join(done, "_as", "left").select(
        "cell_no", "strategy", "size", "overlap", "overlap_chars", zero("n_chunks"), recall.alias("recall_at_5"), F.coalesce("mean_chars", F.lit(0.0)).alias("mean_chars"),
        zero("p95_tokens"), zero("max_tokens"), zero("violations"), zero("rescued"), skipped.alias("skipped"),
    )
