"""Logistic regressions of many folds and configurations, fitted together.

Every Newton step is one pass over the table for all fits at once: each task sums, for each fit,
the loss, the gradient and the Gram matrix over its rows, and the sums are added up by fit and
position. What reaches the driver is a few numbers per pair of features and fit, whatever the
number of rows; the steps themselves are solved there.

All fits share one basis: the features standardised over the whole search part, a constant and,
where a fit wants them, the products of all pairs. Standardising with the statistics of a fold's
own fit part is a linear map of that basis, products included, so the sums of any fold follow from
sums over the basis. The penalty applies in the fold's own scale; the intercept has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from plumbline.operators.scaling import WHOLE_SEARCH

MAX_PASSES = 60
TOLERANCE = 1e-11  # of the objective, by which the next step would lower it
CYCLES = 2000  # of coordinate descent within one step


@dataclass(frozen=True)
class Fit:
    """One regression, on the search rows outside ``fold`` (on all for ``WHOLE_SEARCH``)."""

    fold: int
    c: float
    l1: bool = False
    interactions: bool = False
    balanced: bool = False


def basis(x: np.ndarray, whole: Row, features: Sequence[str], products: bool) -> np.ndarray:
    """Standardised features, a constant, and products of pairs if wanted."""
    if np.isnan(x).any():
        raise ValueError("a feature has missing values")
    mean = np.array([whole[f"mu_{f}"] for f in features])
    deviation = np.array([whole[f"sd_{f}"] or 1.0 for f in features])
    g = (x - mean) / deviation
    columns = [g, np.ones((len(g), 1))]
    if products:
        columns += [(g[:, i] * g[:, j])[:, None] for i, j in combinations(range(len(features)), 2)]
    return np.hstack(columns)


def scaled_by(own: Row, whole: Row, features: Sequence[str], products: bool) -> np.ndarray:
    """The map from the basis to a fold's own design: its features, a constant, its products."""
    d = len(features)
    a = np.array([(whole[f"sd_{f}"] or 1.0) / (own[f"sd_{f}"] or 1.0) for f in features])
    b = np.array([(whole[f"mu_{f}"] - own[f"mu_{f}"]) / (own[f"sd_{f}"] or 1.0) for f in features])
    pairs = list(combinations(range(d), 2)) if products else []
    out = np.zeros((d + 1 + len(pairs),) * 2)
    out[np.arange(d), np.arange(d)] = a
    out[d, :d], out[d, d] = b, 1.0
    for n, (i, j) in enumerate(pairs, d + 1):
        out[n, n], out[i, n], out[j, n], out[d, n] = a[i] * a[j], a[i] * b[j], a[j] * b[i], b[i] * b[j]
    return out


def _weights(fit: Fit, own: Row) -> tuple[float, float]:
    rows, ones = own["fit_rows"], own["fit_ones"]
    return (rows / (2 * (rows - ones)), rows / (2 * ones)) if fit.balanced else (1.0, 1.0)


def _sums(g: np.ndarray, y: np.ndarray, s: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper half of the Gram matrix over some rows, one after the other."""
    eta = g @ beta
    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
    loss = s @ (np.logaddexp(0, eta) - y * eta)
    gram = g.T @ (g * (s * p * (1 - p))[:, None])
    return np.concatenate([[loss], g.T @ (s * (p - y)), gram[np.triu_indices(g.shape[1])]])


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return x, batch.column("y").to_numpy(zero_copy_only=False), batch.column("fold").to_numpy(zero_copy_only=False)


class JointFits:
    """The fits of one prepared table.

    ``table`` has the features, a 0/1 target and ``fold`` (NULL on the holdout); ``statistics``
    are the fit statistics by ``scaler_fold``.
    """

    def __init__(
        self, table: DataFrame, features: Sequence[str], target: str, statistics: Mapping[int, Row]
    ) -> None:
        self.features, self.statistics = list(features), statistics
        self.whole = statistics[WHOLE_SEARCH]
        values = F.array(*[F.col(f).cast("double") for f in features])
        fold = F.coalesce(F.col("fold"), F.lit(WHOLE_SEARCH)).cast("int").alias("fold")
        self.rows = table.select(values.alias("x"), F.col(target).cast("double").alias("y"), fold)
        self.jobs = 0

    def sums(self, fits: Sequence[Fit], betas: Sequence[np.ndarray]) -> list[np.ndarray]:
        """One pass: the sums of every fit at its coefficients over the basis."""
        features, whole = self.features, self.whole
        products = any(f.interactions for f in fits)
        weights = [_weights(f, self.statistics[f.fold]) for f in fits]

        def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, fold = _matrix(batch, len(features))
                g, found = basis(x, whole, features, products), []
                for fit, (zero, one), beta in zip(fits, weights, betas):
                    s = np.where(fold == fit.fold, 0.0, np.where(y == 1, one, zero))
                    found.append(_sums(g[:, : len(beta)], y, s, beta))
                totals = found if totals is None else [a + b for a, b in zip(totals, found)]
            for i, values in enumerate(totals or ()):
                columns = [np.full(len(values), i, np.int32), np.arange(len(values), dtype=np.int32), values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fit", "pos", "value"])

        search = self.rows.where(F.col("fold") != WHOLE_SEARCH)
        added = search.mapInArrow(partial, "fit int, pos int, value double")
        found = added.groupBy("fit", "pos").agg(F.sum("value").alias("value")).toArrow()
        self.jobs += 1
        sizes = [1 + len(b) + len(b) * (len(b) + 1) // 2 for b in betas]
        out = [np.zeros(n) for n in sizes]
        for i, pos, value in zip(*(found.column(c).to_pylist() for c in ("fit", "pos", "value"))):
            out[i][pos] = value
        return out

    def fitted(self, fits: Sequence[Fit]) -> list[np.ndarray]:
        """Coefficients of every fit over the basis."""
        states = [_State(f, self.statistics[f.fold], self.whole, self.features) for f in fits]
        for _ in range(MAX_PASSES):
            open_ = [s for s in states if not s.done]
            if not open_:
                break
            found = self.sums([s.fit for s in open_], [s.map @ s.trial for s in open_])
            for state, values in zip(open_, found):
                state.advance(values)
        return [s.map @ s.beta for s in states]

    def scores(self, fits: Sequence[Fit], betas: Sequence[np.ndarray], held: bool) -> DataFrame:
        """``fit, _y, score``: each fit on its own fold's rows, or on the holdout."""
        features, whole = self.features, self.whole
        products = any(f.interactions for f in fits)

        def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y, fold = _matrix(batch, len(features))
                g = basis(x, whole, features, products)
                for i, (fit, beta) in enumerate(zip(fits, betas)):
                    own = np.full(len(y), True) if held else fold == fit.fold
                    score = 1 / (1 + np.exp(-np.clip(g[own, : len(beta)] @ beta, -700, 700)))
                    columns = [np.full(len(score), i, np.int32), y[own].astype(np.int32), score]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fit", "_y", "score"])

        part = F.col("fold") == WHOLE_SEARCH
        return self.rows.where(part if held else ~part).mapInArrow(scored, "fit int, _y int, score double")


class _State:
    """Where one fit stands: accepted coefficients, and the ones on trial in the next pass."""

    def __init__(self, fit: Fit, own: Row, whole: Row, features: Sequence[str]) -> None:
        self.fit, self.map = fit, scaled_by(own, whole, features, fit.interactions)
        self.constant = len(features)
        self.beta = self.trial = np.zeros(len(self.map))
        self.value, self.done = np.inf, False
        if own["fit_ones"] in (0, own["fit_rows"]):
            # One class only: nothing to learn, every row scores alike.
            self.done = True

    def advance(self, values: np.ndarray) -> None:
        """Accept the trial and plan a Newton step from it, or try half the step."""
        n = len(self.map)
        value = values[0] + self._penalty(self.trial)
        if value > self.value + 1e-13 * abs(self.value):
            half = (self.trial - self.beta) / 2
            self.done = np.abs(half).max() < 1e-12
            self.trial = self.beta + half
            return
        self.beta, self.value = self.trial, value
        gram = np.zeros((n, n))
        gram[np.triu_indices(n)] = values[1 + n :]
        gram = gram + np.triu(gram, 1).T
        gradient, gram = self.map.T @ values[1 : 1 + n], self.map.T @ gram @ self.map
        step, gain = self._lasso(gradient, gram) if self.fit.l1 else self._ridge(gradient, gram)
        self.done = gain <= TOLERANCE * (1 + abs(value))
        self.trial = self.beta + step
        if self.done:
            self.beta = self.trial  # so short a step needs no further pass

    def _penalised(self) -> np.ndarray:
        return np.arange(len(self.beta)) != self.constant

    def _penalty(self, beta: np.ndarray) -> float:
        w = beta[self._penalised()]
        return (np.abs(w).sum() if self.fit.l1 else w @ w / 2) / self.fit.c

    def _ridge(self, gradient: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, float]:
        inside = self._penalised() / self.fit.c
        total = gradient + inside * self.beta
        step = -np.linalg.lstsq(gram + np.diag(inside), total, rcond=None)[0]
        return step, float(-total @ step / 2)

    def _lasso(self, gradient: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, float]:
        """Coordinate descent on the quadratic model with the absolute penalty."""
        penalty = self._penalised() / self.fit.c
        curve = np.maximum(np.diag(gram), 1e-10)
        step, slope = np.zeros(len(gradient)), gradient.copy()
        for _ in range(CYCLES):
            largest = 0.0
            for j in range(len(step)):
                at = self.beta[j] + step[j]
                free = at - slope[j] / curve[j]
                move = np.sign(free) * max(abs(free) - penalty[j] / curve[j], 0.0) - at
                if move:
                    step[j] += move
                    slope += gram[:, j] * move
                    largest = max(largest, abs(move))
            if largest < 1e-12:
                break
        gain = -(gradient @ step + step @ gram @ step / 2 + penalty @ (np.abs(self.beta + step) - np.abs(self.beta)))
        return step, float(gain)


def first_step(table: DataFrame, features: Sequence[str], target: str, statistics: Mapping[int, Row]) -> DataFrame:
    """The sums that the first Newton step of every fold starts from: ``fold, row, col, value``.

    Rows and columns are named like the features and ``1``; column ``gradient`` is the gradient.
    At zero coefficients they are plain sums, which any SQL engine can add up.
    """
    folds = [k for k in statistics if k != WHOLE_SEARCH]
    joint, names = JointFits(table, features, target, statistics), [*features, "1"]
    n = len(names)
    found = joint.sums([Fit(k, 1.0) for k in folds], [np.zeros(n)] * len(folds))
    rows = []
    for k, values in zip(folds, found):
        rows += [(k, names[i], "gradient", float(values[1 + i])) for i in range(n)]
        at = zip(*np.triu_indices(n))
        rows += [(k, names[i], names[j], float(v)) for (i, j), v in zip(at, values[1 + n :])]
    return table.sparkSession.createDataFrame(rows, "fold int, row string, col string, value double")
