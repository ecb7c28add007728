"""Fitting on a bounded labelled sample: a fixed number of shards, each fitted in its own task, averaged after each round."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

SHARDS = 6


def held_out(id_col: str, modulus: int, rest: int):
    """Rows whose crc32(id as text) leaves ``rest``; never learned from. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, max_rows: int, columns: list[str], id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """About ``max_rows`` labelled rows at most (by hash of the id), dealt to shards; two labels of one id: the larger."""
    own = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, modulus, rest))
    own = own.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(label).cast("int").alias("y"))
    share = min(1.0, max_rows / max(1, own.count()))
    place = F.pmod(F.xxhash64("label_id"), F.lit(1 << 30))
    chosen = own.filter(place < int(share * (1 << 30))).withColumn("place", place)
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), *columns)
    rows = rows.join(F.broadcast(chosen), "label_id").withColumn("shard", (F.col("place") % shards).cast("int"))
    return stage(rows.drop("label_id"), "labelled")


def _turn(sent, turn: int, epoch):
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        own = {k: v.copy() for k, v in sent.value.items()}
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        epoch(rows, own, turn)
        names, places, moves = [], [], []
        for k, v in own.items():
            was, now = sent.value[k].ravel(), v.ravel()
            moved = np.flatnonzero(now != was)
            names.append(k)
            places.append(moved.astype(np.int32).tobytes())
            moves.append((now[moved] - was[moved]).astype(np.float32).tobytes())
        return pd.DataFrame({"shard": int(rows["shard"].iloc[0]), "name": names, "place": places, "move": moves})

    return one


def fit(sample: DataFrame, start: dict[str, np.ndarray], rounds: int, epoch) -> dict[str, np.ndarray]:
    """``epoch(rows, state, round)`` goes once over a shard's rows and changes ``state``; states are averaged.

    What travels is one state of fixed size a shard, whatever the size of the corpus.
    """
    sc = sample.sparkSession.sparkContext
    state = start
    for turn in range(rounds):
        sent = sc.broadcast(state)
        parts = sample.groupBy("shard").applyInPandas(_turn(sent, turn, epoch), "shard int, name string, place binary, move binary").collect()
        sent.unpersist()
        sums = {k: (np.zeros(v.size), np.zeros(v.size, np.int32)) for k, v in state.items()}
        for part in sorted(parts, key=lambda r: (r["shard"], r["name"])):
            at = np.frombuffer(part["place"], np.int32)
            total, count = sums[part["name"]]
            total[at] += np.frombuffer(part["move"], np.float32)
            count[at] += 1
        # the mean over the shards that moved a coordinate: rare features keep their step
        state = {k: (v.ravel() + sums[k][0] / np.maximum(1, sums[k][1])).astype(v.dtype).reshape(v.shape) for k, v in state.items()}
        del parts
    return state
