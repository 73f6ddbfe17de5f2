"""Gradient-boosted decision trees for two classes.

`fit` takes a table of features in numpy. `fit_rows` learns from all rows of a DataFrame: each level of
a tree is one Spark job, whose tasks add up gradients by node, feature and bin. What comes to the driver
is one sum for each of these, however many rows there are. Margins are whole steps of 1 / GRID between
-LARGEST and LARGEST, so that calibration and threshold need no more than counts by step.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32
GRID, LARGEST = 1024, 32
_SHRINK, _LEAST = 1.0, 1.0
# Sums of gradients are whole numbers of this unit, so they do not depend on the order of the rows.
_UNIT = 2.0 ** -32


@dataclass
class Boosted:
    """Trees of equal depth: the feature and limit of each inner node, the value of each leaf."""

    start: float = 0.0
    features: list = field(default_factory=list)
    limits: list = field(default_factory=list)
    values: list = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.clip(self._added(x), -LARGEST, LARGEST) * GRID) / GRID

    def _added(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for features, limits, values in zip(self.features, self.limits, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, features[at]] > limits[at])
            out += values[at - (2 ** DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.margin(x))

    def scaled(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _best_split(g, h):
    """(gain, feature, bin) of the best split of the rows of a node, whose gradients and second
    derivatives are summed by feature and bin; None if none gains."""
    best = None
    total_g, total_h = g[0].sum(), h[0].sum()
    for f in range(len(g)):
        left_g, left_h = g[f][:-1].cumsum(), h[f][:-1].cumsum()
        right = total_h - left_h
        gain = left_g ** 2 / (left_h + _SHRINK) + (total_g - left_g) ** 2 / (right + _SHRINK) - total_g ** 2 / (total_h + _SHRINK)
        gain[(left_h < _LEAST) | (right < _LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = gain[k], f, k
    return best


_INNER = 2 ** DEPTH - 1


@dataclass
class _Tree:
    """A tree while it grows: limits are bins, and a row goes to the right if its bin is larger."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(_INNER, np.int64))
    limits: np.ndarray = field(default_factory=lambda: np.full(_INNER, np.inf))
    values: np.ndarray = field(default_factory=lambda: np.zeros(2 ** DEPTH))

    def split(self, level: int, bins: list[int], sums: dict) -> None:
        """Split the nodes of a level by their sums (node to g and h by feature and bin); at the last
        one the leaves get their values."""
        for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
            if node not in sums:
                continue
            g, h = sums[node]
            found = _best_split(g, h)
            if found and found[2] < bins[found[1]]:
                self.features[node], self.limits[node] = found[1], found[2]
            if level == DEPTH - 1:
                k = min(self.limits[node] + 1, g.shape[1])
                sides = np.split(np.stack([g, h])[:, self.features[node]], [int(k)], axis=1)
                self.values[2 * node + 1 - _INNER:2 * node + 3 - _INNER] = [RATE * x[0].sum() / (x[1].sum() + _SHRINK) for x in sides]

    def reached(self, codes: np.ndarray, level: int) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        for _ in range(level):
            at = 2 * at + 1 + (codes[np.arange(len(codes)), self.features[at]] > self.limits[at])
        return at


def _sums(model: Boosted, tree: _Tree, level: int, codes, y, n) -> dict:
    """For each node of a level that rows (each counting n times) reach, their sums by feature and bin
    in whole units."""
    p = 1 / (1 + np.exp(-model._added(codes)))
    gradient, hessian = [np.rint(v / _UNIT).astype(np.int64) * n for v in (y - p, p * (1 - p))]
    at, out = tree.reached(codes, level), {}
    for node in np.unique(at).tolist():
        inside = np.flatnonzero(at == node)
        cells = codes[inside].astype(np.int64) + (BINS + 1) * np.arange(codes.shape[1])
        out[node] = [np.zeros(codes.shape[1] * (BINS + 1), np.int64) for _ in range(2)]
        for total, v in zip(out[node], (gradient, hessian), strict=True):
            np.add.at(total, cells.ravel(), np.repeat(v[inside], codes.shape[1]))
    return out


def _as_floats(sums: dict) -> dict:
    return {node: [v.reshape(-1, BINS + 1) * _UNIT for v in both] for node, both in sums.items()}


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many cuts are smaller."""
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _started(share: float) -> Boosted:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Boosted(start=float(np.log(share / (1 - share))))


def _append(model: Boosted, tree: _Tree) -> None:
    model.features.append(tree.features)
    model.limits.append(tree.limits)
    model.values.append(tree.values)


def _finished(model: Boosted, cuts: list[np.ndarray]) -> Boosted:
    """The model with values of features, not bins, as limits."""
    model.limits = [np.array([cuts[f][int(k)] if np.isfinite(k) else np.inf for f, k in zip(features, limits, strict=True)])
                    for features, limits in zip(model.features, model.limits, strict=True)]
    return model


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Boosted:
    """Trees by histograms of quantiles, each fitted to the gradient of the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    codes, bins, n = _codes(x, cuts), [len(c) for c in cuts], np.ones(len(x), np.int64)
    model = _started(y.mean())
    for _ in range(rounds):
        tree = _Tree()
        for level in range(DEPTH):
            tree.split(level, bins, _as_floats(_sums(model, tree, level, codes, y, n)))
        _append(model, tree)
    return _finished(model, cuts)


def quantiles(rows: DataFrame, width: int) -> dict[int, list[np.ndarray]]:
    """By kind the cuts of every feature: the quantiles of all rows (kind, n, features as doubles), each
    counting n times."""
    def task(batches):
        for batch in batches:
            kinds, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch.column(2), "<f8", width)
            for kind in np.unique(kinds).tolist():
                mine = kinds == kind
                for f in range(width):
                    values, where = np.unique(x[mine, f], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), v, np.int32)) for v in (kind, f)]
                        + [pa.array(values), pa.array(np.bincount(where, n[mine]).astype(np.int64))], names=["kind", "feature", "value", "n"])

    counts = rows.select("kind", "n", "features").mapInArrow(task, "kind int, feature int, value double, n long").groupBy(
        "kind", "feature", "value").agg(F.sum("n").alias("n"))
    upto = "sum(n) OVER (PARTITION BY kind, feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto"
    totals = rows.groupBy("kind").agg(F.sum("n").alias("total"))
    placed = counts.selectExpr("*", upto).join(F.broadcast(totals), "kind")
    # A value is a quantile if one of the places asked for lies among its rows.
    place = f"(k * (total - 1)) div {BINS}"
    kept = placed.filter(F.expr(f"exists(sequence(1, {BINS - 1}), k -> {place} >= upto - n AND {place} < upto)"))
    cuts = {}
    for kind, f, value in kept.select("kind", "feature", "value").collect():
        cuts.setdefault(kind, [[] for _ in range(width)])[f].append(value)
    return {kind: [np.sort(np.array(c)) for c in of] for kind, of in cuts.items()}


def _matrix(column, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def coded(rows: DataFrame, cuts: dict[int, list[np.ndarray]], width: int) -> DataFrame:
    """Rows (kind, label, n, codes) of the kinds in `cuts`: bins in place of values."""
    def task(batches):
        for batch in batches:
            kinds, x = batch.column(0).to_numpy(), _matrix(batch.column(3), "<f8", width)
            codes = np.zeros(x.shape, np.uint8)
            for kind in np.unique(kinds).tolist():
                codes[kinds == kind] = _codes(x[kinds == kind], cuts[kind])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary())], names=["kind", "label", "n", "codes"])

    mine = rows.filter(F.col("kind").isin(list(cuts))).select("kind", "label", "n", "features")
    return mine.mapInArrow(task, "kind int, label int, n long, codes binary")


def fit_rows(rows: DataFrame, cuts: dict[int, list[np.ndarray]], shares: dict[int, float], rounds: int = ROUNDS) -> dict[int, Boosted]:
    """`fit` for all kinds at once, from all rows made by `coded`; `shares` are those of label 1."""
    models = {kind: _started(shares[kind]) for kind in cuts}
    width = max((len(c) for c in cuts.values()), default=0)
    for _ in range(rounds if cuts else 0):
        trees = {kind: _Tree() for kind in cuts}
        for level in range(DEPTH):
            found = _level(rows, models, trees, level, width)
            for kind, tree in trees.items():
                tree.split(level, [len(c) for c in cuts[kind]], _as_floats(found.get(kind, {})))
        for kind, tree in trees.items():
            _append(models[kind], tree)
    return {kind: _finished(model, cuts[kind]) for kind, model in models.items()}


def _level(rows: DataFrame, models: dict, trees: dict, level: int, width: int) -> dict:
    """By kind and node the sums of all rows, as `_sums` makes them."""
    def task(batches):
        total = {}
        for batch in batches:
            kinds, y, n = [batch.column(i).to_numpy() for i in range(3)]
            codes = _matrix(batch.column(3), "u1", width)
            for kind in np.unique(kinds).tolist():
                mine = kinds == kind
                for node, both in _sums(models[kind], trees[kind], level, codes[mine], y[mine], n[mine]).items():
                    old = total.get((kind, node))
                    total[kind, node] = both if old is None else [a + b for a, b in zip(old, both, strict=True)]
        for (kind, node), (g, h) in total.items():
            cells = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), v, np.int32)) for v in (kind, node)]
                + [pa.array(cells.astype(np.int32)), pa.array(g[cells]), pa.array(h[cells])], names=["kind", "node", "cell", "g", "h"])

    sums = rows.mapInArrow(task, "kind int, node int, cell int, g long, h long").groupBy("kind", "node", "cell").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    kinds, nodes, cells, g, h = [c.to_numpy() for c in sums.columns]
    out = {}
    for kind, node in {*zip(kinds.tolist(), nodes.tolist(), strict=True)}:
        mine = (kinds == kind) & (nodes == node)
        both = out.setdefault(kind, {})[node] = [np.zeros(width * (BINS + 1), np.int64) for _ in range(2)]
        for total, v in zip(both, (g, h), strict=True):
            total[cells[mine]] = v[mine]
    return out


def margin_counts(rows: DataFrame, models: dict[int, Boosted], width: int) -> dict[int, tuple]:
    """By kind (margins, rows of label 1, rows) of all rows (kind, label, n, features): one entry for
    each step of the margin that occurs."""
    def task(batches):
        for batch in batches:
            kinds, y, n = [batch.column(i).to_numpy() for i in range(3)]
            x = _matrix(batch.column(3), "<f8", width)
            steps = np.zeros(len(x), np.int32)
            for kind in np.unique(kinds).tolist():
                steps[kinds == kind] = np.rint(models[kind].margin(x[kinds == kind]) * GRID)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps), pa.array(y * n), batch.column(2)], names=["kind", "step", "hits", "n"])

    mine = rows.filter(F.col("kind").isin(list(models))).select("kind", "label", "n", "features")
    counts = mine.mapInArrow(task, "kind int, step int, hits long, n long").groupBy("kind", "step").agg(
        F.sum("hits").alias("hits"), F.sum("n").alias("n")).orderBy("kind", "step").toArrow()
    kinds, steps, hits, n = [c.to_numpy() for c in counts.columns]
    return {kind: (steps[kinds == kind] / GRID, hits[kinds == kind], n[kinds == kind]) for kind in models}


def calibrate(model: Boosted, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Logistic scaling of the margin on rows that the trees have not seen."""
    calibrate_counts(model, model.margin(x), y, np.ones(len(y), np.int64), steps)


def calibrate_counts(model: Boosted, m: np.ndarray, hits: np.ndarray, n: np.ndarray, steps: int = 50) -> None:
    """The same from margins, and of each the rows of label 1 and all rows."""
    target = hits * ((hits.sum() + 1) / (hits.sum() + 2)) + (n - hits) / ((n - hits).sum() + 2)
    w = np.array([1.0, 0.0])
    design = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (target - n * p) - 1e-3 * (w - [1.0, 0.0]))
        w = w + np.clip(step, -1, 1)
    model.slope, model.shift = float(max(w[0], 1e-3)), float(w[1])


def threshold(probability: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The least probability from which on so large a share is of class 1, halfway to the next lower
    one; above 1 where there is none. With `n`, an entry stands for so many rows, y of them of class 1."""
    order = np.argsort(-probability, kind="stable")
    p, hits = probability[order], np.cumsum(y[order])
    good = hits >= precision * (np.arange(1, len(p) + 1) if n is None else np.cumsum(n[order]))
    good &= np.append(p[1:] < p[:-1], True)
    if not len(p) or not good.any() or hits[-1] == 0:
        return 2.0
    k = int(np.flatnonzero(good)[-1])
    return float((p[k] + p[k + 1]) / 2) if k + 1 < len(p) else float(p[k])
