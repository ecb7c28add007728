"""Hard-negative mining: branch and bound down ball trees, one tree for each few thousand rows of a partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ball_tree import BallTree, Best
from .common import small_batches, stage

#: Components become floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative scores from LOW to HIGH percent of its positive.
LOW, HIGH = 50, 95
#: Rows of a tree; trees and anchors that meet in one task at most, and the tasks wanted where there are trees for so many.
TREE_ROWS = 2048
CELL_TREES, CELL_ANCHORS, CELLS = 512, 65_536, 64
#: Squared norm from which scores could leave a long once multiplied by a percentage.
MAX_NORM2 = 2.0**55
_FAR = 2**62
_FOUND = "anchor_row long, pos int, score long, id long"


def quantized(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``row`` (a number of its own), ``id``, ``label`` and ``v`` (integers) of the rows that take part, as a written table."""
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    good = good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).filter(norm2 < MAX_NORM2)
    return stage(good.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; shorter vectors end in zeros."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _build(width: int):
    def build(batches):
        held, n = [], 0

        def trees(least: int):
            nonlocal held, n
            while n >= least and n:
                v, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                ids, labels, rows = (x[:TREE_ROWS] for x in rest)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:1]), pa.array([BallTree(v[:TREE_ROWS], ids, labels, rows).to_bytes()], pa.binary())], ["first_row", "tree"])
                held, n = [(v[TREE_ROWS:], *(x[TREE_ROWS:] for x in rest))], max(0, n - TREE_ROWS)

        for batch in batches:
            held.append((_matrix(batch.column("v"), width), *(batch.column(c).to_numpy() for c in ("id", "label", "row"))))
            n += batch.num_rows
            yield from trees(TREE_ROWS)
        yield from trees(1)

    return build


def _search(width: int, windows: int, k: int, same_label: bool):
    """A task's cells one after the other: the anchors of a cell come first, then its trees, one in memory at a time."""

    def found(anchors, best):
        for w, b in enumerate(best):
            r, c = np.nonzero(b.score > -_FAR)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(anchors[0][r]), pa.array(np.full(len(r), w, np.int32)), pa.array(b.score[r, c]), pa.array(b.id[r, c])], ["anchor_row", "pos", "score", "id"])

    def limits(positive: list[list[int]]):
        low, high = np.full((len(positive), windows), _FAR), np.full((len(positive), windows), -_FAR)
        for i, scores in enumerate(positive):
            for w, p in enumerate(scores):
                a, b = -((-LOW * p) // 100), (HIGH * p) // 100
                if a <= b:
                    low[i, w], high[i, w] = a, b
        return low, high

    def run(batches):
        at, held, anchors, best, low, high = None, [], None, [], None, None
        for batch in batches:
            for i, (g, s, side) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "s", "side")), strict=True)):
                if at != (g, s):
                    if best:
                        yield from found(anchors, best)
                    at, held, anchors, best = (g, s), [], None, []
                if side == 0:
                    held.append(batch.slice(i, 1))
                    continue
                if not held and anchors is None:
                    continue
                if anchors is None:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    anchors, held = (table.column("row").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("v"), width)), []
                    if same_label:
                        low, high = np.full((len(anchors[0]), 1), -_FAR), np.full((len(anchors[0]), 1), _FAR)
                    else:
                        low, high = limits(table.column("scores").to_pylist())
                    best = [Best(len(anchors[0]), k) for _ in range(windows)]
                tree = BallTree.from_bytes(batch.column("tree")[i].as_py())
                tree.search(anchors[2], anchors[1], same_label, low, high, best, anchors[0] if same_label else None)
        if best:
            yield from found(anchors, best)

    return run


def _best(anchors: DataFrame, trees: DataFrame, width: int, windows: int, k: int, same_label: bool) -> DataFrame:
    """``anchor_row``, ``pos`` (window), ``rank``, ``score``, ``id``: the ``k`` best rows of each window.

    Anchors are dealt to groups and trees to slabs, both of bounded size; a group and a slab meet in a cell, and the best of the
    cells are ranked once more.
    """
    n, t = anchors.count(), trees.count()
    groups = max(1, -(-n // CELL_ANCHORS))
    slabs = max(1, min(t, max(-(-t // CELL_TREES), -(-CELLS // groups))))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = anchors.select(deal("row", groups).alias("g"), F.lit(0).alias("side"), "row", "label", "v", "scores", F.lit(None).cast("binary").alias("tree")).withColumn("s", every(slabs))
    nothing = [F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("label"), *[F.lit(None).cast("array<long>").alias(c) for c in ("v", "scores")]]
    held = trees.select(deal("first_row", slabs).alias("s"), F.lit(1).alias("side"), *nothing, "tree").withColumn("g", every(groups))
    met = asked.unionByName(held).repartition(min(4 * groups * slabs, 10_000), "g", "s").sortWithinPartitions("g", "s", "side")
    found = met.mapInArrow(_search(width, windows, k, same_label), _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "pos").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor`` says of the column ``id`` which rows are anchors. Components become floor(scale * x), scores are integer inner products. An
    anchor's positives are its POSITIVES best other rows of its label, higher scores first, then smaller ids; for each of them
    the NEGATIVES best rows of other labels that score between LOW and HIGH percent of it, ranked from 1. Trees are built over
    whole partitions as they come, so no label or vector is a key that rows are dealt by; each tree bounds the inner products
    of its nodes from both sides, and a node goes unread when it lies outside an anchor's windows or strictly beneath its
    k-th best. All rows are searched; the result is exact.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do vectors so long (a
    squared norm of 2^55) that their scores could leave a long. Vectors of unequal length meet as if the shorter ended in zeros. Each row is a row
    of its own: a repeated row can be another's positive, a repeated anchor is mined once a row. Equal scores with one id take
    the next ranks. An anchor without other rows of its label, or without rows in a window, gives no rows; so does an empty table. Two written tables stay until
    ``common.drop_staged``. Extra columns are not read.
    """
    small_batches(rows.sparkSession)
    vectors = quantized(rows, id_col, vector_col, label_col, scale)
    width = max(1, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    trees = stage(vectors.mapInArrow(_build(width), "first_row long, tree binary"), "ball-trees")
    anchors = vectors.filter(is_anchor)
    none = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    first = _best(none, trees, width, 1, POSITIVES, True)
    positives = stage(first.select("anchor_row", (F.col("rank") - 1).alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores, anchors.row == scores.anchor_row).drop("anchor_row")
    negatives = _best(asked, trees, width, POSITIVES, NEGATIVES, False)
    named = positives.join(anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return negatives.join(named, ["anchor_row", "pos"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 50 == 0)


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.alike
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""
