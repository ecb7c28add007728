"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text
from .fitting import fit, held_out, labelled_sample
from .words import K1, K3, WORD, mix, word_hashes

BITS = 20
#: The bound of the labelled sample that is learned from, and the held-out third.
MAX_ROWS, MODULUS, REST = 12_000, 3, 1
THRESHOLD = 0.7
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 1.0, 12.0, 0.1
POSITIVE_WEIGHT = 2.0
#: What a word pair or skip-pair weighs against a word.
PAIR = 0.3
#: Parts of the sample that are scored by a model of the others, to place the threshold.
FOLDS = 3
#: F1 that the cut may give away to lie higher, where clean documents are safer.
SLACK = 0.003
#: Share of toxic rows among those that a cut marks, below which it is no cut: a filter must not take more clean documents than toxic ones.
LEAST_PRECISION = 0.5
#: The logit of THRESHOLD.
PLAIN = float(np.log(THRESHOLD / (1 - THRESHOLD)))


def features(text: str) -> tuple[np.ndarray, int]:
    """Distinct slots, the intercept's (0) and the words' first, then those of pairs and of pairs with one word skipped; how many come first."""
    h = word_hashes(WORD.findall(text.lower()))
    with np.errstate(over="ignore"):
        pairs = np.concatenate([mix(h[:-1] * K1 + h[1:]), mix(h[:-2] * K3 + h[2:])])
    shift = np.uint64(64 - BITS)
    words = np.unique(np.append(h >> shift, np.uint64(0)))
    return np.concatenate([words, np.setdiff1d(pairs >> shift, words)]).astype(np.int32), len(words)


def _values(many: int, words: int) -> np.ndarray:
    x = np.full(many, PAIR)
    x[:words] = 1.0
    return x


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def _learn(known: list[tuple[np.ndarray, int]], labels: list[int], z: np.ndarray, n: np.ndarray) -> None:
    """FTRL-proximal steps over the rows, EPOCHS times: each coordinate has its own rate, L1 keeps most weights at zero."""
    for (at, words), y in list(zip(known, labels, strict=True)) * EPOCHS:
        x = _values(len(at), words)
        w = _weights(z[at], n[at])
        g = (_probability(w @ x) - y) * (POSITIVE_WEIGHT if y else 1.0) * x
        root = np.sqrt(n[at])
        z[at] += g - (np.sqrt(n[at] + g * g) - root) / ALPHA * w
        n[at] += g * g


def best_cut(logits: np.ndarray, labels: np.ndarray, least: float = 0.0) -> float:
    """The highest logit that parts the labels with the best F1 but for SLACK; that of THRESHOLD where there is nothing to part.

    Cuts with a precision below ``least`` are left out. Without any other, as with a model of a few labels that tells nothing, the cut is that of THRESHOLD,
    or of the highest logit where that is more.
    """
    if not 0 < labels.sum() < len(labels):
        return PLAIN
    order = np.argsort(-logits, kind="stable")
    s, y = logits[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # no cut between equal scores
    f1[hits < least * np.arange(1, len(y) + 1)] = 0
    if not f1.any():
        return max(PLAIN, float(np.nextafter(s[0], np.inf)))
    k = int(np.flatnonzero(f1 >= f1.max() - SLACK)[0])
    return min(PLAIN, float((s[k] + s[min(k + 1, len(s) - 1)]) / 2))


def _epochs(rows, state, turn):
    known, labels = [features(text or "") for text in rows["t"]], rows["y"].to_numpy()
    fold, logits = np.arange(len(known)) % FOLDS, np.zeros(len(known))
    for k in range(FOLDS):
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        others = np.flatnonzero(fold != k)
        _learn([known[i] for i in others], labels[others].tolist(), z, n)
        w = _weights(z, n)
        for i in np.flatnonzero(fold == k):
            at, words = known[i]
            logits[i] = w[at] @ _values(len(at), words)
    state["cut"][0] = best_cut(logits, labels, LEAST_PRECISION)
    _learn(known, labels.tolist(), state["z"], state["n"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and weights that are not zero, and the logit that gets the score THRESHOLD; learned from at most about
    MAX_ROWS labelled rows outside the held-out third.

    Online learning is sequential, so the bounded sample is one shard, gone over EPOCHS times. L1 draws all logits to
    zero, the more so in a small sample; so the cut is placed by models that have not seen the rows they score.
    """
    sample = labelled_sample(docs.withColumn("t", F.col(text_col)), labels, "toxic", MODULUS, REST, MAX_ROWS, ["t"], id_col, shards=1)
    start = {"z": np.zeros(1 << BITS), "n": np.zeros(1 << BITS), "cut": np.full(1, PLAIN)}
    state = fit(sample, start, 1, _epochs)
    w = _weights(state["z"], state["n"])
    slots = np.flatnonzero(w)
    return slots.astype(np.int32), w[slots].astype(np.float32), float(state["cut"][0])


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 from 0.7 on). Null texts are scored as empty ones.

    The sparse weights are broadcast: at most 2^20 of eight bytes, whatever the corpus. An empty table gives an
    empty one; columns with the results' names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        slots, values, cut = sent.value
        w = np.zeros(1 << BITS, np.float32)
        w[slots] = values
        shift = PLAIN - cut

        def one(text: str) -> float:
            at, words = features(text)
            return _probability(float(w[at[:words]].sum(dtype=np.float64) + PAIR * w[at[words:]].sum(dtype=np.float64)) + shift)

        return lambda texts: [list(map(one, texts))]

    out = map_text(docs, text_col, {"score": "double"}, make)
    return out.withColumns({"held_out": held_out(id_col, MODULUS, REST), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def query(spark, sf_dir):
    from .common import documents, labels

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score_toxicity(docs, train(docs, labels(spark, sf_dir))).select("doc_id", "held_out", "score", "predicted")
