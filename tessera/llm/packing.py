"""Best-fit packing planned over a histogram of lengths; pieces take planned slots by their rank within a length."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, stage
from .pretoken import library_encoder

VOCABULARY = "word_bpe_49k.json"
END = 1
CAPACITY = 4096
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of slots (length, first rank, how many, first sequence, offset) by best-fit decreasing over ``counts``.

    Pieces of a run take sequences one after the other at one offset. The work and the plan depend on the number
    of different lengths (``capacity`` at most), not on the number of pieces.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}
    rests: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(rest: int, first: int, many: int) -> None:
        if rest > 0 and many > 0:
            if rest not in open_bins:
                open_bins[rest] = []
                bisect.insort(rests, rest)
            open_bins[rest].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rests, length)
            if at < len(rests):
                rest = rests[at]
                first, many = open_bins[rest].pop()
                used = min(many, left)
                if used < many:
                    open_bins[rest].append((first + used, many - used))
                if not open_bins[rest]:
                    del open_bins[rest], rests[at]
                runs.append((length, rank, used, first, capacity - rest))
                put(rest - length, first, used)
                rank, left = rank + used, left - used
                continue
            each = capacity // length
            for many, fill in ((left // each, each), (1, left % each)):
                if many and fill:
                    for k in range(fill):
                        runs.append((length, rank, many, sequences, k * length))
                        rank += many
                    put(capacity - fill * length, sequences, many)
                    sequences += many
            left = 0
    return np.asarray(runs, np.int64).reshape(-1, 5)


def _pieces(vocabulary: str, capacity: int):
    def cut(batches):
        encoder = library_encoder(vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part_of in (x for batch in batches for x in slices(batch, [1])):
            rows = []
            for key, ids in zip(part_of.column(0).to_pylist(), encoder.encode(part_of.column(1).to_pylist()), strict=True):
                ids = np.append(np.frombuffer(ids, encoder.kind).astype("<u4"), np.uint32(END))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    piece = ids[start : start + capacity]
                    rows.append((key, k, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), part, int(seen[len(piece)])))
                    seen[len(piece)] += 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])

    return cut


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Spans of tokens in sequences: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Each document is its ids and the end id; one longer than ``capacity`` is cut. A null text is an empty one (one
    piece with the end id). Rows with one id and rows with a null id are documents of their own. An empty table
    gives an empty one. Pieces are numbered within (task, length) as they are cut, so ranks need only the counts
    of each task and length, and no length is gathered in one place.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    pieces = stage(rows.mapInArrow(_pieces(vocabulary, capacity), _PIECES), "pieces")
    counts = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = docs.sparkSession.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the counts grow with the number of tasks: never broadcast
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))

    def seat(batches):
        runs = sent.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            columns = [batch.column(i) for i in range(5)] + [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir, vocabulary: str | None = None):
    from .common import documents

    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"), vocabulary or public_tokenizers.path(VOCABULARY))
