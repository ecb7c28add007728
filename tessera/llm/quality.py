"""Quality: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .fitting import fit, held_out, labelled_sample
from .words import WORD, word_hashes

BITS, FACTORS = 15, 8
#: The bound of the labelled sample that is learned from, and the held-out quarter.
MAX_ROWS, MODULUS, REST = 16_000, 4, 2
THRESHOLD = 0.7
ROUNDS, RATE, DECAY = 4, 0.05, 1e-5
#: Slots after the hashed words: the intercept, the statistics, then one for each power of two of the stated length.
N_STATS, N_LENGTHS = 19, 34
STATS = 1 << BITS
WIDTH = STATS + N_STATS + N_LENGTHS
#: What of a text the words weigh against the statistics.
WORD_SHARE = 0.5

_CLASSES = np.zeros((256, 10), np.float32)
for _i, _set in enumerate([range(65, 91), range(97, 123), range(48, 58), range(128, 256), b" ", b"\n", b".,;:", b"!?", b"|#$%&*+=<>@^_~/\\{}[]", b"\"'()-`"]):
    _CLASSES[list(_set), _i] = 1


def _statistics(text: str, raw_words: list[str], h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size, n = max(1, len(data)), max(1, len(h))
    lines = text.split("\n")
    out = np.zeros(N_STATS)
    out[0] = 1.0
    out[1:11] = np.bincount(data, minlength=256) @ _CLASSES / size
    out[1:11] = np.sqrt(out[1:11])
    out[11] = np.log1p(len(h)) / 10
    out[12] = sum(map(len, raw_words)) / n / 10
    out[13] = len(counts) / n
    out[14] = counts.max() / n if len(counts) else 0.0
    out[15] = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    out[16] = len(set(lines)) / len(lines)
    out[17] = min(1.0, size / len(lines) / 1000)
    out[18] = float(sum(w.isupper() for w in raw_words)) / n
    return out


def features(text: str, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values; the words' values have a norm of WORD_SHARE."""
    raw = WORD.findall(text)
    h = word_hashes([w.lower() for w in raw])
    slots, counts = np.unique(h >> np.uint64(64 - BITS), return_counts=True)
    values = np.log1p(counts)
    values *= WORD_SHARE / max(1e-9, float(np.sqrt((values * values).sum())))
    stats = _statistics(text, raw, h, counts)
    length = STATS + N_STATS + (0 if stated is None or stated < 0 else 1 + min(N_LENGTHS - 2, int(stated).bit_length()))
    at = np.concatenate([slots.astype(np.int64), np.arange(STATS, STATS + N_STATS), [length]])
    return at, np.concatenate([values, stats, [0.3]])


def _logit(w: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum-of-squares identity gives all pairs' interactions in time linear in the features."""
    summed = x @ v
    return float(w @ x + 0.5 * (summed @ summed - ((x * x) @ (v * v)).sum())), summed


def _probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def _epoch(rows, state, turn):
    w, v, gw, gv = state["w"], state["v"], state["gw"], state["gv"]
    for text, stated, y in zip(rows["t"], rows["stated"], rows["y"], strict=True):
        at, x = features(text or "", None if stated is None or stated != stated else int(stated))
        own = v[at]
        logit, summed = _logit(w[at], own, x)
        g = _probability(logit) - y
        dw = g * x + DECAY * w[at]
        dv = g * (x[:, None] * summed - (x * x)[:, None] * own) + DECAY * own
        gw[at] += dw * dw
        gv[at] += dv * dv
        w[at] -= RATE * dw / np.sqrt(gw[at] + 1e-8)
        v[at] -= RATE * dv / np.sqrt(gv[at] + 1e-8)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> dict[str, np.ndarray]:
    """Weights and factors, learned from at most about MAX_ROWS labelled rows outside the held-out quarter; zeros without any."""
    rows = docs.withColumns({"t": F.col(text_col), "stated": F.col(length_col).cast("long")})
    sample = labelled_sample(rows, labels, "quality", MODULUS, REST, MAX_ROWS, ["t", "stated"], id_col)
    start = {
        "w": np.zeros(WIDTH, np.float32),
        "v": np.random.default_rng(7).normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32),
        "gw": np.zeros(WIDTH, np.float32),
        "gv": np.zeros((WIDTH, FACTORS), np.float32),
    }
    if not sample.head(1):
        return {k: np.zeros_like(start[k]) for k in ("w", "v")}
    state = fit(sample, start, ROUNDS, _epoch)
    return {k: state[k] for k in ("w", "v")}


def score_quality(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from 0.7 on).

    Null texts are scored as empty ones, a null stated length has a slot of its own. The model is broadcast:
    a fixed 1.2 MB. An empty table gives an empty one; columns with the results' names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        w, v = sent.value["w"].astype(np.float64), sent.value["v"].astype(np.float64)

        def one(text, stated):
            at, x = features(text, stated)
            return _probability(_logit(w[at], v[at], x)[0])

        return lambda texts, lengths: [list(map(one, texts, lengths))]

    out = map_text(docs, text_col, {"score": "double"}, make, [length_col])
    return out.withColumns({"held_out": held_out(id_col, MODULUS, REST), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def query(spark, sf_dir):
    from .common import documents, labels

    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    return score_quality(docs, train(docs, labels(spark, sf_dir))).select("doc_id", "held_out", "score", "predicted")
