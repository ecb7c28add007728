"""States of the hidden Markov model against a direct version in logarithms."""

import numpy as np
import pytest

from tessera.operators import models


def direct(x):
    x = (x - x.mean(0)) / (x.std(0) + 1e-12)
    best, states, n = -np.inf, None, len(x)
    for seed in range(5):
        label = models.two_clusters(x, seed)
        mean = np.array([x[label == k].mean(0) for k in (0, 1)])
        var = np.array([x[label == k].var(0) + 1e-3 for k in (0, 1)])
        b = np.array([[sum(-0.5 * (np.log(2 * np.pi * v) + (y - m) ** 2 / v) for y, m, v in zip(row, mean[k], var[k], strict=True)) for k in (0, 1)] for row in x])
        t = np.array([[1.0 + sum(label[i] == p and label[i + 1] == q for i in range(n - 1)) for q in (0, 1)] for p in (0, 1)])
        t, init = t / t.sum(1, keepdims=True), np.array([1 - label.mean(), label.mean()])
        for _ in range(120):
            f, r = np.zeros((n, 2)), np.zeros((n, 2))
            f[0] = np.log(init + 1e-300) + b[0]
            for i in range(1, n):
                f[i] = b[i] + [np.logaddexp(*(f[i - 1] + np.log(t[:, k]))) for k in (0, 1)]
            for i in range(n - 2, -1, -1):
                r[i] = [np.logaddexp(*(np.log(t[k]) + b[i + 1] + r[i + 1])) for k in (0, 1)]
            g = f + r
            g = np.exp(g - np.logaddexp(g[:, 0], g[:, 1])[:, None])
            t = g[:-1].T @ g[1:] / g[:-1].sum(0)[:, None]
            t = np.clip(0.6 * t + 0.4 * np.array([[0.9, 0.1], [0.1, 0.9]]), 0.05, 0.95)
            t, init = t / t.sum(1, keepdims=True), g[0]
        if g.mean(0).min() >= 0.05 and (ll := np.logaddexp(*f[-1])) > best:
            best, states = ll, g.argmax(1) if mean[0, 0] <= mean[1, 0] else 1 - g.argmax(1)
    return states


def test_states():
    rng = np.random.default_rng(3)
    high = np.repeat([1, 0, 1, 0, 1], 26)
    x = np.column_stack([rng.normal(0.8 * high, 1), rng.normal(1 - high, 0.8), rng.normal(high, 1.2)])
    got = models.two_state_hmm(x)
    assert (got == direct(x)).all()
    assert x[got == 1, 0].mean() > x[got == 0, 0].mean()


def test_forward_backward_in_blocks():
    """Shares and likelihood equal those of a plain pass, for lengths about a square."""
    rng = np.random.default_rng(8)
    for n in (2, 3, 120, 121, 143, 144, 145, 1000):
        like, trans, start = rng.random((n, 2)) + 1e-9, np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.4, 0.6])
        f, r = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = np.log(start * like[0])
        for i in range(1, n):
            f[i] = np.log(like[i]) + [np.logaddexp(*(f[i - 1] + np.log(trans[:, k]))) for k in (0, 1)]
        for i in range(n - 2, -1, -1):
            r[i] = [np.logaddexp(*(np.log(trans[k] * like[i + 1]) + r[i + 1])) for k in (0, 1)]
        want = np.exp(f + r - np.logaddexp(*(f[-1])))
        gamma, total = models.forward_backward(like, trans, start)
        assert np.allclose(gamma, want) and total == pytest.approx(np.logaddexp(*f[-1]))


def test_every_row_comes_back(spark):
    """A series of one state, one that is too short and rows with nulls have null states; the others those of the direct version."""
    rng = np.random.default_rng(3)
    high = np.repeat([1, 0, 1, 0, 1], 26)
    x = np.column_stack([rng.normal(0.8 * high, 1), rng.normal(1 - high, 0.8), rng.normal(high, 1.2)])
    rows = [("two", i, *map(float, v)) for i, v in enumerate(x)] + [("two", 500, None, 1.0, 1.0)]
    rows += [("one", i, 1.0, 1.0, 1.0) for i in range(150)] + [("short", i, float(i), 1.0, 1.0) for i in range(30)]
    frame = spark.createDataFrame(rows, "code string, i int, a double, b double, c double")
    got = {(r.code, r.i): r.state for r in models.hmm_labels(frame, "code", "i", ["a", "b", "c"]).collect()}
    assert len(got) == len(rows)
    assert [got["two", i] for i in range(len(x))] == direct(x).tolist()
    assert got["two", 500] is None and {v for (code, _), v in got.items() if code != "two"} == {None}
