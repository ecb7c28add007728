"""Cross-sectional and time-series models: small dense solves on Arrow groups, everything else as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import normal_cdf, winsorize


def _bartlett(df: DataFrame, by: str, order: str, x: str, lags: int) -> tuple[DataFrame, Column]:
    """``df`` with the mean ``_m`` of each series, and the aggregate of its squared deviations with Bartlett weights 1 - l / (lags + 1)."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.withColumn("_m", F.avg(x).over(Window.partitionBy(by))).withColumn("_e", F.col(x) - F.col("_m"))
    d = d.withColumns({f"_e{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    s = F.sum(F.col("_e") * F.col("_e"))
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0))
    return d, s


def _t_of_mean(mean: str, s: str, n: str) -> Column:
    return F.col(mean) / F.nullif(F.sqrt(F.greatest(s, F.lit(0.0))) / F.col(n), F.lit(0.0))


def newey_west(df: DataFrame, by: str, order: str, x: str, lags: int = 4) -> DataFrame:
    """t of the mean of ``x`` in each series with Bartlett weights 1 - l / (lags + 1)."""
    d, s = _bartlett(df, by, order, x, lags)
    return d.groupBy(by).agg(F.count("*").alias("n"), F.max("_m").alias("mean"), s.alias("_s")).select(by, "n", "mean", _t_of_mean("mean", "_s", "n").alias("nw_t"))


def crowding(returns: DataFrame, by: str, order: str, r: str, recent: int = 60, before: int = 120) -> DataFrame:
    """Sharpe and volatility of the last ``recent`` periods and the ``before`` ones; crowded with two flags of three."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    x = returns.withColumn("_b", back)
    now, old = F.when(F.col("_b") <= recent, F.col(r)), F.when((F.col("_b") > recent) & (F.col("_b") <= recent + before), F.col(r))
    a = x.groupBy(by).agg(F.avg(now).alias("m1"), F.stddev_samp(now).alias("s1"), F.avg(old).alias("m0"), F.stddev_samp(old).alias("s0"))
    year = F.sqrt(F.lit(252.0))
    a = a.withColumns({
        "sharpe": F.coalesce(F.col("m1") / F.nullif("s1", F.lit(0.0)) * year, F.lit(0.0)), "vol": F.col("s1") * year,
        "sharpe_prev": F.coalesce(F.col("m0") / F.nullif("s0", F.lit(0.0)) * year, F.lit(0.0)), "vol_prev": F.col("s0") * year})
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    flags = one((F.col("sharpe_prev") > 0) & (F.col("sharpe") < F.col("sharpe_prev") * 0.5)) + one(F.col("vol") > F.col("vol_prev") * 1.3) + one(F.col("m1") < 0)
    out = a.withColumn("flags", flags)
    return out.select(by, F.round("sharpe", 3).alias("sharpe"), F.round("vol", 4).alias("vol"), F.round("sharpe_prev", 3).alias("sharpe_prev"), F.round("vol_prev", 4).alias("vol_prev"), F.round("m1", 6).alias("mean_return"), "flags", (F.col("flags") >= 2).alias("crowded"))


def gram(rows: DataFrame, by: list[str], factors: list[str], y: str) -> DataFrame:
    """``by``, ``n``, ``gram``: the sums of products of 1, the factors and ``y`` by group, row by row of the upper triangle.

    One aggregate, partial before the shuffle: what a group sends on is (k + 2)(k + 3) / 2 numbers a task, however many rows it has.
    """
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in factors], F.col(y).cast("double")]
    sums = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("gram"))


def industry_neutral(rows: DataFrame, by: list[str], value: str, industry: str, least: int = 30) -> DataFrame:
    """``rows`` with ``neutral``: ``value`` winsorized in its group, less the mean of its industry there (the residual on dummies).

    Groups under ``least`` rows and constant ones keep their values; null values stay null.
    """
    w = Window.partitionBy(*by)
    held = rows.withColumns({"_w": winsorize(value, window=w), "_k": F.count(value).over(w), "_s": F.stddev_pop(value).over(w)})
    apart = F.col("_w") - F.avg("_w").over(Window.partitionBy(*by, industry))
    return held.withColumn("neutral", F.when((F.col("_k") >= least) & (F.col("_s") > 0), apart).otherwise(F.col(value))).drop("_w", "_k", "_s")


def _square(flat, k: int) -> np.ndarray:
    """The symmetric (k + 2) x (k + 2) matrix of an upper triangle."""
    out = np.zeros((k + 2, k + 2))
    out[np.triu_indices(k + 2)] = flat
    return out + np.triu(out, 1).T


def ols(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients (intercept first), their t and R squared from a Gram matrix; the shortest of them where columns depend on each other."""
    n, xx, xy = g[0, 0], g[:-1, :-1], g[:-1, -1]
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    rest, total = max(_left(g, beta), 0.0), g[-1, -1] - g[0, -1] ** 2 / n
    se = np.sqrt(np.maximum(np.diag(inverse) * rest / max(1.0, n - len(xx)), 0))
    return beta, np.divide(beta, se, out=np.zeros_like(beta), where=se > 0), float(1 - rest / total) if total > 0 else 0.0


def _left(g: np.ndarray, beta: np.ndarray) -> float:
    """The sum of squared residuals."""
    return float(g[-1, -1] - 2 * beta @ g[:-1, -1] + beta @ g[:-1, :-1] @ beta)


def ridge(g: np.ndarray, alpha: float) -> np.ndarray:
    """Closed form; the intercept is not penalized."""
    penalty = np.eye(len(g) - 1) * alpha
    penalty[0, 0] = 0
    return np.linalg.solve(g[:-1, :-1] + penalty, g[:-1, -1])


def lasso(g: np.ndarray, alpha: float, rounds: int = 500, tol: float = 1e-6) -> np.ndarray:
    """Coordinate descent on standardized columns; alpha is not scaled by the rows, so small values shrink nothing."""
    n, mean, xx = g[0, 0], g[0, -1] / g[0, 0], g[1:-1, 1:-1]
    target, beta = g[1:-1, -1] - mean * g[0, 1:-1], np.zeros(len(xx))
    for _ in range(rounds):
        old = beta.copy()
        for j in range(len(beta)):
            rho = target[j] - xx[j] @ beta + xx[j, j] * beta[j]
            beta[j] = math.copysign(max(0.0, abs(rho) - alpha), rho) / n
        if np.abs(beta - old).max() < tol:
            break
    return np.append(mean, beta)


def cross_section_models(rows: DataFrame, by: str | list[str], factors: list[str], y: str, least: int = 30, alpha_ridge: float = 1.0, alpha_lasso: float = 0.001) -> DataFrame:
    """OLS (with t and a normal two-sided p), ridge and LASSO in each group with ``least`` rows or more.

    All three come from the group's Gram matrix, so no group's rows are gathered; Python sees one small matrix a group. Rows need no nulls in
    ``factors`` and ``y``.
    """
    by = [by] if isinstance(by, str) else by
    sums = gram(rows, by, factors, y).filter(F.col("n") >= least)
    names = ["intercept", *factors]

    def fit(batches):
        for part in batches:
            out = []
            for row in part.itertuples(index=False):
                g = _square(row.gram, len(factors))
                beta, t, r2 = ols(g)
                total = g[-1, -1] - g[0, -1] ** 2 / g[0, 0]
                for name, coef in (("ols", beta), ("ridge", ridge(g, alpha_ridge)), ("lasso", lasso(g, alpha_lasso))):
                    score = r2 if name == "ols" else float(1 - _left(g, coef) / total) if total > 0 else 0.0
                    out += [(*row[: len(by)], name, f, float(coef[k]), float(t[k]) if name == "ols" else None, score, int(row.n)) for k, f in enumerate(names)]
            yield pd.DataFrame(out, columns=[*by, "model", "factor", "coef", "t", "r2", "n"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    fitted = sums.mapInPandas(fit, f"{schema}, model string, factor string, coef double, t double, r2 double, n long")
    return fitted.withColumn("p", 2 * (1 - normal_cdf(F.abs("t"))))


def coefficient_summary(models: DataFrame, split: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, positive share, mean size, mean t, share of large t, mean R squared and Newey-West t, by ``by``, model, factor and half; one pass, so the fits are made once."""
    half = F.when(F.col("month") < F.lit(split).cast("date"), "in_sample").otherwise("out_of_sample")
    keys = [*by, "model", "factor", "half"]
    m = models.withColumn("half", half).withColumn("key", F.concat_ws("|", *keys))
    d, s = _bartlett(m, "key", "month", "coef", 4)
    agg = d.groupBy("key", *keys).agg(
        s.alias("_s"), F.max("_m").alias("_m"), F.count("*").alias("months"), F.avg("coef").alias("mean"), F.median("coef").alias("median"), F.avg((F.col("coef") > 0).cast("double")).alias("positive"),
        F.avg(F.abs("coef")).alias("mean_abs"), F.avg("t").alias("mean_t"), F.avg((F.abs("t") > 2).cast("double")).alias("large_t"), F.avg("r2").alias("mean_r2"))
    return agg.withColumn("nw_t", _t_of_mean("_m", "_s", "months")).drop("key", "_s", "_m")


# ---- volatility ----


def _unit(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _garch_terms(theta: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.exp(np.minimum(theta[..., 0], 700.0)), *(_unit(theta[..., i]) for i in (1, 2, 3))


def garch_loss(theta: np.ndarray, r2: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Half the negative log likelihood of parameters (..., series, 4) for squared returns (days, series): all series and trial points go through the days together."""
    omega, alpha, gamma, beta = _garch_terms(theta)
    bad = alpha + gamma / 2 + beta >= 0.9999
    omega, beta = np.where(bad, 1.0, omega), np.where(bad, 0.0, beta)
    h, total = np.broadcast_to(r2.mean(0), omega.shape).copy(), np.zeros(omega.shape)
    for x, neg in zip(r2, negative, strict=True):
        total += np.log(h) + x / h
        h = omega + (alpha + gamma * neg) * x + beta * h
    return np.where(bad, 1e12, total / 2)


def nelder_mead(f, start: np.ndarray, rounds: int = 200, step: float = 0.5) -> np.ndarray:
    """The least of ``f`` for each of many problems (rows of ``start``), which go through the rounds together; ``f(points, which)`` takes points (..., problems, k)."""
    count, k = start.shape
    points = np.stack([start] + [start + step * np.eye(k)[i] for i in range(k)], axis=1)  # problem, corner, parameter
    everyone = np.arange(count)
    values = f(points.transpose(1, 0, 2), everyone).T
    live = everyone
    for _ in range(rounds):
        order = np.argsort(values, axis=1, kind="stable")
        points, values = np.take_along_axis(points, order[:, :, None], 1), np.take_along_axis(values, order, 1)
        live = live[np.abs(values[live, -1] - values[live, 0]) >= 1e-8 * (1 + np.abs(values[live, 0]))]
        if not len(live):
            break
        p, v = points[live], values[live]
        mid = p[:, :-1].mean(1)
        tried = np.stack([mid + c * (p[:, -1] - mid) for c in (-1.0, -2.0, 0.5)])
        near, far, half = f(tried, live)
        chosen = np.select([(near < v[:, 0]) & (far < near), near < v[:, -2], half < v[:, -1]], [1, 0, 2], -1)
        moved, shrunk = np.flatnonzero(chosen >= 0), np.flatnonzero(chosen < 0)
        points[live[moved], -1], values[live[moved], -1] = tried[chosen[moved], moved], np.stack([near, far, half])[chosen[moved], moved]
        if len(shrunk):
            which = live[shrunk]
            points[which, 1:] = points[which, :1] + (points[which, 1:] - points[which, :1]) / 2
            values[which, 1:] = f(points[which, 1:].transpose(1, 0, 2), which).T
    return points[everyone, values.argmin(1)]


def fit_garch(returns: np.ndarray, asymmetric: bool = False) -> dict[str, np.ndarray]:
    """GARCH(1,1) or GJR by likelihood for each row of ``returns`` (series, days), or one series; ``forecast`` is the next day's volatility."""
    x = np.atleast_2d(np.asarray(returns, float))
    x = (x - x.mean(1, keepdims=True)).T
    r2, negative = x * x, (x < 0).astype(float)
    base = np.maximum(r2.mean(0), 1e-12)
    logit = lambda v: math.log(v / (1 - v))
    # the symmetric model has no third parameter: it is held where its share is nothing
    free = (lambda t: t) if asymmetric else (lambda t: np.stack([t[..., 0], t[..., 1], np.full(t.shape[:-1], -50.0), t[..., 2]], -1))
    rest = [logit(0.08), *([logit(0.03)] if asymmetric else []), logit(0.85)]
    start = np.column_stack([np.log(base * 0.05), *(np.full(len(base), v) for v in rest)])
    theta = free(nelder_mead(lambda t, which: garch_loss(free(t), r2[:, which], negative[:, which]), start))
    omega, alpha, gamma, beta = _garch_terms(theta)
    h = base
    for v, neg in zip(r2, negative, strict=True):
        h = omega + (alpha + gamma * neg) * v + beta * h
    out = {"omega": omega, "alpha": alpha, "gamma": gamma, "beta": beta, "persistence": alpha + gamma / 2 + beta, "forecast": np.sqrt(h)}
    return out if np.ndim(returns) == 2 else {k: float(v[0]) for k, v in out.items()}


def rolling_garch(windows: DataFrame) -> DataFrame:
    """GARCH and GJR fits for each row of (window_id, returns): batches of windows are fitted together, batches side by side."""
    names = ["omega", "alpha", "gamma", "beta", "persistence", "forecast"]

    def fit(batches):
        for part in batches:
            sizes = part.returns.map(len).to_numpy()
            for size in np.unique(sizes):
                some = part[sizes == size]
                returns = np.stack(some.returns.to_numpy())
                for model in ("GARCH", "GJR"):
                    fitted = fit_garch(returns, model == "GJR")
                    yield pd.DataFrame({"window_id": some.window_id.to_numpy(), "model": model} | {k: fitted[k] for k in names})

    return windows.mapInPandas(fit, "window_id long, model string, " + ", ".join(f"{k} double" for k in names))


def rolling_windows(returns: DataFrame, by: str, order: str, r: str, size: int, step: int) -> DataFrame:
    """Windows of ``size`` rows each ``step`` rows, where a row follows: ``window_id``, ``returns`` and that row's ``order``."""
    w = Window.partitionBy(by).orderBy(order)
    i = F.row_number().over(w).cast("long")
    numbered = returns.select(by, order, r, i.alias("i"))
    first, last = F.greatest(F.ceil((F.col("i") - size) / step), F.lit(0)), F.floor((F.col("i") - 1) / step)
    placed = numbered.filter(first <= last).withColumn("window_id", F.explode(F.sequence(first, last)))
    windows = placed.groupBy(by, "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", r))), lambda s: s[r]).alias("returns")).filter(F.size("returns") == size)
    ends = numbered.filter((F.col("i") > size) & ((F.col("i") - size - 1) % step == 0)).select(by, ((F.col("i") - size - 1) / step).cast("long").alias("window_id"), order)
    return windows.join(ends, [by, "window_id"])


def compare_forecasts(forecasts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Mean squared error, QLIKE and share of right directions of ``forecast`` and of the rival ``realized_20d``, against ``realized_next``.

    A direction is that from the forecast before; the first of a series counts as none on both sides, so as right.
    """
    w = Window.partitionBy(*by).orderBy(order)
    up = lambda c: F.coalesce(F.col(c) > F.lag(c).over(w), F.lit(False))
    x = forecasts.filter("realized_20d is not null and realized_next is not null")
    x = x.withColumns({"_g": (up("forecast") == up("realized_next")).cast("double"), "_h": (up("realized_20d") == up("realized_next")).cast("double")})
    error = lambda c: F.avg(F.pow(F.col(c) - F.col("realized_next"), 2.0))

    def qlike(c: str):
        ratio = F.col("realized_next") / F.nullif(F.col(c), F.lit(0.0))
        return F.avg(ratio - F.ln(F.nullif(ratio, F.lit(0.0))) - 1)

    out = x.groupBy(*by).agg(
        F.count("*").alias("periods"), error("forecast").alias("mse_garch"), error("realized_20d").alias("mse_hist"), qlike("forecast").alias("qlike_garch"), qlike("realized_20d").alias("qlike_hist"),
        F.avg("_g").alias("direction_garch"), F.avg("_h").alias("direction_hist"))
    better = {"better_by_mse": F.col("mse_garch") < F.col("mse_hist"), "better_by_qlike": F.col("qlike_garch") < F.col("qlike_hist")}
    return out.withColumn("mse_ratio", F.col("mse_garch") / F.nullif("mse_hist", F.lit(0.0))).withColumns(better)


# ---- regimes ----


def two_clusters(x: np.ndarray, seed: int) -> np.ndarray:
    """Label (0 or 1) of each row by k-means from two seeded rows, the second drawn by squared distance."""
    rng = np.random.default_rng(seed)
    a = x[rng.integers(len(x))]
    d = ((x - a) ** 2).sum(1)
    centers = np.stack([a, x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else a])
    for _ in range(20):
        label = ((x[:, None] - centers) ** 2).sum(2).argmin(1)
        centers = np.stack([x[label == k].mean(0) if (label == k).any() else centers[k] for k in (0, 1)])
    return label


#: The transitions' prior, the weight of the estimate beside it, their bounds, the least share of a state and of labelled rows.
PRIOR, TAU, TRANS_BOUNDS, LEAST_SHARE, LEAST_ROWS = np.array([[0.9, 0.1], [0.1, 0.9]]), 0.6, (0.05, 0.95), 0.05, 120


def forward_backward(like: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Share of each state in each row, and the logarithm of the whole likelihood.

    A step is a 2 x 2 matrix and steps multiply associatively, so blocks of about the root of the rows are multiplied
    side by side, scaled at each step, and only the blocks are gone through one after the other.
    """
    n = len(like)
    size = max(1, math.isqrt(n))
    blocks = -(-(n - 1) // size)
    steps = np.tile(np.eye(2), (blocks * size, 1, 1))
    steps[: n - 1] = trans * like[1:, None, :]
    steps = steps.reshape(blocks, size, 2, 2)
    ahead, behind, logs = np.empty_like(steps), np.empty_like(steps), np.zeros(blocks)
    now = np.tile(np.eye(2), (blocks, 1, 1))
    for k in range(size):
        now = now @ steps[:, k]
        scale = now.sum((1, 2))
        now = now / scale[:, None, None]
        logs += np.log(scale)
        ahead[:, k] = now
    now = np.tile(np.eye(2), (blocks, 1, 1))
    for k in range(size - 1, -1, -1):
        behind[:, k] = now
        now = steps[:, k] @ now
        now = now / now.sum((1, 2))[:, None, None]
    first = start * like[0]
    total, v, entry = math.log(first.sum()), first / first.sum(), np.empty((blocks, 2))
    for i in range(blocks):
        entry[i] = v
        v = v @ ahead[i, -1]
        total += math.log(v.sum()) + logs[i]
        v = v / v.sum()
    w, leave = np.ones(2), np.empty((blocks, 2))
    for i in range(blocks - 1, -1, -1):
        leave[i] = w
        w = now[i] @ w
        w = w / w.sum()
    alpha, beta = np.empty_like(like), np.empty_like(like)
    alpha[0], beta[0] = first, w
    alpha[1:] = np.einsum("bi,bkij->bkj", entry, ahead).reshape(-1, 2)[: n - 1]
    beta[1:] = np.einsum("bkij,bj->bki", behind, leave).reshape(-1, 2)[: n - 1]
    gamma = alpha * beta
    return gamma / gamma.sum(1, keepdims=True), total


def fit_states(x: np.ndarray, seed: int, rounds: int = 120) -> tuple[float, np.ndarray] | None:
    """Likelihood and most probable state (0: the one of lower mean return) of each row of one restart.

    Fixed Gaussian emissions from two seeded clusters, re-estimated transitions. None where a state has less than LEAST_SHARE.
    """
    x = (x - x.mean(0)) / (x.std(0) + 1e-12)
    label = two_clusters(x, seed)
    if label.min() == label.max():
        return None
    means = np.stack([x[label == k].mean(0) for k in (0, 1)])
    var = np.stack([x[label == k].var(0) + 1e-3 for k in (0, 1)])
    logp = -0.5 * (((x[:, None] - means) ** 2 / var) + np.log(2 * np.pi * var)).sum(2)
    like = np.exp(logp - logp.max(1, keepdims=True))
    trans = np.ones((2, 2))
    np.add.at(trans, (label[:-1], label[1:]), 1)
    trans /= trans.sum(1, keepdims=True)
    start = np.array([(label == k).mean() for k in (0, 1)]) + 1e-6
    start /= start.sum()
    for _ in range(rounds):
        gamma, total = forward_backward(like, trans, start)
        if gamma.sum(0).min() < 1e-6:
            break
        trans = gamma[:-1].T @ gamma[1:] / np.maximum(gamma[:-1].sum(0)[:, None], 1e-12)  # no pairwise term: states of neighbours as if apart
        trans = np.clip(TAU * trans + (1 - TAU) * PRIOR, *TRANS_BOUNDS)
        trans /= trans.sum(1, keepdims=True)
        start = gamma[0]
    if gamma.mean(0).min() < LEAST_SHARE:
        return None
    states = gamma.argmax(1)
    return total + float(logp.max(1).sum()), 1 - states if means[0, 0] > means[1, 0] else states


def two_state_hmm(x: np.ndarray, restarts: int = 5) -> np.ndarray | None:
    """The states of the likeliest restart, the earlier one of equals; None where no restart gives both states their share."""
    fits = [f for f in (fit_states(x, seed) for seed in range(restarts)) if f is not None]
    return max(fits, key=lambda f: f[0])[1] if fits else None


def hmm_labels(features: DataFrame, by: str, order: str, columns: list[str], restarts: int = 5) -> DataFrame:
    """``by``, ``order`` and ``state`` of every row of ``features``; rows with nulls, and series of under LEAST_ROWS rows or without two states, have a null state.

    Restarts are rows: each (series, restart) is a group of its own, so they run side by side, and the likeliest one is joined
    back to all rows. A series (one index, as long as the calendar) is held by one task a restart.
    """
    whole = features.select(by, order, *columns).dropna()
    tries = whole.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))

    def label(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        fit = fit_states(part[columns].to_numpy(float), int(part.restart.iloc[0])) if len(part) >= LEAST_ROWS else None
        out = part[[by, order, "restart"]].copy()
        return out.assign(score=fit[0], state=fit[1]) if fit else out.iloc[:0].assign(score=0.0, state=0)

    kind = lambda c: features.schema[c].dataType.simpleString()
    found = tries.groupBy(by, "restart").applyInPandas(label, f"{by} {kind(by)}, {order} {kind(order)}, restart int, score double, state int")
    best = found.groupBy(by, order).agg(F.max_by("state", F.struct("score", -F.col("restart"))).alias("state"))
    return features.select(by, order).join(best, [by, order], "left")
