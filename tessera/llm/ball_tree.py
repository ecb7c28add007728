"""A ball tree over integer vectors, searched by branch and bound for many queries at once."""

from __future__ import annotations

import io

import numpy as np

LEAF = 128
#: Queries that go down a tree together.
TOGETHER = 1024
NOTHING = np.iinfo(np.int64).min
#: Products below this are exact as doubles.
EXACT = 2.0**52


class Best:
    """For each of ``m`` queries the ``k`` best (score, id) found, higher scores first, then smaller ids."""

    def __init__(self, m: int, k: int):
        self.k, self.score, self.id = k, np.full((m, k), NOTHING), np.zeros((m, k), np.int64)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, wanted: np.ndarray) -> None:
        """Offer ``score`` (len(rows) x len(ids)) where ``wanted``; only what reaches a row's k-th best is looked at."""
        wanted &= score >= self.score[rows, -1:]
        some = np.flatnonzero(wanted.any(axis=1))
        if not len(some):
            return
        masked = np.where(wanted[some], score[some], NOTHING)
        if masked.shape[1] > self.k:
            masked[masked < np.partition(masked, -self.k, axis=1)[:, -self.k][:, None]] = NOTHING
        r, c = np.nonzero(masked != NOTHING)
        old_r, old_c = np.nonzero(self.score[rows[some]] != NOTHING)
        row = np.concatenate([r, old_r])
        values = np.concatenate([masked[r, c], self.score[rows[some]][old_r, old_c]])
        names = np.concatenate([ids[c], self.id[rows[some]][old_r, old_c]])
        order = np.lexsort((names, -values, row))
        row, values, names = row[order], values[order], names[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        self.score[rows[some]] = NOTHING
        self.score[rows[some][row[top]], place[top]] = values[top]
        self.id[rows[some][row[top]], place[top]] = names[top]


class BallTree:
    """Nodes have a center, a radius and the range of their labels; leaves are runs of the rows as ordered here.

    A node of several labels is cut between labels first, so that most nodes hold one label; then at the median along the
    line between two rows far apart.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.order = np.lexsort((ids, labels))
        points = vectors.astype(np.float64)
        self.nodes: list[tuple] = []  # begin, end, left, right
        self._split(points, labels, 0, len(ids))
        self.vectors, self.ids, self.labels, self.rows = vectors[self.order], ids[self.order], labels[self.order], rows[self.order]
        points = points[self.order]
        self.centers = np.array([points[a:b].mean(axis=0) for a, b, *_ in self.nodes]).reshape(len(self.nodes), points.shape[1])
        self.radii = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, *_), c in zip(self.nodes, self.centers, strict=True)])
        self.low = np.array([self.labels[a:b].min() for a, b, *_ in self.nodes])
        self.high = np.array([self.labels[a:b].max() for a, b, *_ in self.nodes])
        self.largest = float(np.sqrt((points**2).sum(axis=1).max())) if len(ids) else 0.0

    _ARRAYS = ("nodes", "vectors", "ids", "labels", "rows", "centers", "radii", "low", "high", "largest")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: np.asarray(getattr(self, name)) for name in self._ARRAYS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as arrays:
            for name in cls._ARRAYS:
                setattr(tree, name, arrays[name])
        return tree

    def _split(self, points: np.ndarray, labels: np.ndarray, a: int, b: int) -> int:
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1))
        if b - a <= LEAF:
            return me
        own = labels[self.order[a:b]]
        if own[0] != own[-1]:
            cuts = np.flatnonzero(np.diff(own)) + 1
            middle = a + int(cuts[np.abs(cuts - (b - a) // 2).argmin()])
        else:
            x = points[self.order[a:b]]
            one = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            other = x[((x - one) ** 2).sum(axis=1).argmax()]
            self.order[a:b] = self.order[a:b][np.argsort(x @ (other - one), kind="stable")]
            middle = (a + b) // 2
        self.nodes[me] = (a, b, self._split(points, labels, a, middle), self._split(points, labels, middle, b))
        return me

    def search(self, queries: np.ndarray, labels: np.ndarray, same_label: bool, low: np.ndarray, high: np.ndarray, best: list[Best], skip: np.ndarray | None = None) -> int:
        """Offer rows to ``best[w]`` for each query and its windows w: ``low[:, w]`` <= score <= ``high[:, w]``.

        Only rows of the query's label, or only those of other labels; the row numbered ``skip`` is no answer. Returns how many pairs were scored.
        """
        scored = 0
        for at in range(0, len(queries), TOGETHER):
            rows = np.arange(at, min(at + TOGETHER, len(queries)))
            scored += self._down(0, rows, queries, np.sqrt((queries[rows].astype(np.float64) ** 2).sum(axis=1)), labels, same_label, low, high, best, skip)
        return scored

    def _open(self, node: int, rows, queries, norms, labels, same_label, low, high, best):
        """Which queries may find something in a node."""
        middle = queries[rows].astype(np.float64) @ self.centers[node]
        reach = norms * self.radii[node]
        slack = 1e-6 + 1e-9 * (np.abs(middle) + reach)
        top, bottom = middle + reach + slack, middle - reach - slack
        if same_label:
            fits = (labels[rows] >= self.low[node]) & (labels[rows] <= self.high[node])
        else:
            fits = (labels[rows] != self.low[node]) | (labels[rows] != self.high[node])
        window = np.zeros(len(rows), bool)
        for w, b in enumerate(best):
            window |= (top >= low[rows, w]) & (bottom <= high[rows, w]) & (top >= b.score[rows, -1])
        return fits & window, top

    def _down(self, node, rows, queries, norms, labels, same_label, low, high, best, skip) -> int:
        live, top = self._open(node, rows, queries, norms, labels, same_label, low, high, best)
        rows, norms, top = rows[live], norms[live], top[live]
        if not len(rows):
            return 0
        a, b, left, right = self.nodes[node]
        if left >= 0:
            # the child with the higher bounds goes first: it raises the k-th best for the other
            first = [queries[rows].astype(np.float64) @ self.centers[n] + norms * self.radii[n] for n in (left, right)]
            pair = (left, right) if first[0].mean() >= first[1].mean() else (right, left)
            return sum(self._down(n, rows, queries, norms, labels, same_label, low, high, best, skip) for n in pair)
        if norms.max() * self.largest < EXACT:
            score = np.rint(queries[rows].astype(np.float64) @ self.vectors[a:b].T.astype(np.float64)).astype(np.int64)
        else:
            score = queries[rows] @ self.vectors[a:b].T
        fits = (labels[rows][:, None] == self.labels[a:b]) == same_label
        if skip is not None:
            fits &= skip[rows][:, None] != self.rows[a:b]
        for w, one in enumerate(best):
            one.offer(rows, score, self.ids[a:b], fits & (score >= low[rows, w][:, None]) & (score <= high[rows, w][:, None]))
        return score.size
