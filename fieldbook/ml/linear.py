"""Penalised linear models from second moments.

A linear fit needs only the counts, means and centred products of its columns. They are taken once per fold, on the
executors, and merged without cancellation; a whole grid of penalties with its cross-validation is then solved on
matrices of (features + 1) squared. One scan replaces one scan per setting and fold. Each solution comes with its
duality gap, the most by which its penalised error can lie above the least.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.numeric import linear_score

# Moments are merged inside tasks; they travel with them, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Penalty:
    """``alpha`` times a mix of absolute (share ``l1_ratio``) and squared weights.

    ``ridge`` uses the sum of squared errors, the others its half mean, as is usual for each.
    """

    alpha: float
    l1_ratio: float = 0.0
    ridge: bool = False


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        return linear_score(self.features, self.coefficients, self.intercept)


@dataclass(frozen=True)
class GridResult:
    model: LinearModel
    best: Penalty
    best_mse: float
    table: list[tuple[float, float, float]]  # alpha, l1_ratio, mean squared error over folds
    gaps: list[float]  # of each row of the table, the widest over folds


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred products of (features, label); adding two of them merges their rows."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n), self.products + other.products + np.outer(step, step) * (self.n * other.n / n))

    def row(self) -> list[float]:
        return [self.n, *self.mean, *self.products.ravel()]

    @staticmethod
    def of_row(values: np.ndarray, width: int) -> Moments:
        return Moments(float(values[0]), values[1 : width + 1].copy(), values[width + 1 :].reshape(width, width).copy())


def merged(parts: Sequence[Moments]) -> Moments:
    return reduce(Moments.__add__, parts)


#: Groups in which the parts of tasks are merged before those of a fold.
_MERGERS = 64
_PARTS = "fold int, part int, m array<double>"


def moments(df: DataFrame, features: Sequence[str], label: str, fold: str | None = None) -> dict[int, Moments]:
    """Per fold, the moments of (features, label). Rows with a null or NaN among these or without a fold are left out.

    The columns travel as one array, and incomplete rows are found inside the task: a filter over many columns makes the
    optimizer derive its constraints for every alias of every column.
    """
    names = [*features, label]
    width = len(names)
    picked = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("v"))

    def rows(found: dict[int, Moments], part: int) -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.int32()), pa.array([part] * len(found), pa.int32()), pa.array([m.row() for m in found.values()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["fold", "part", "m"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            folds = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            z = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            whole = ~(np.isnan(z).any(axis=1) | np.isnan(folds))
            for number in np.unique(folds[whole]):
                here = z[whole & (folds == number)]
                mean = here.mean(axis=0)
                m = Moments(float(len(here)), mean, (here - mean).T @ (here - mean))
                found[int(number)] = found[int(number)] + m if int(number) in found else m
        yield rows(found, TaskContext.get().partitionId() % _MERGERS)

    def merge(parts: pa.Table) -> pa.Table:
        m = merged([Moments.of_row(np.array(x), width) for x in parts["m"].to_pylist()])
        return pa.Table.from_batches([rows({parts["fold"][0].as_py(): m}, 0)])

    parts = picked.mapInArrow(partial, _PARTS).groupBy("fold", "part").applyInArrow(merge, _PARTS).groupBy("fold").applyInArrow(merge, _PARTS)
    return {row["fold"]: Moments.of_row(np.array(row["m"]), width) for row in parts.orderBy("fold").collect()}  # folds * (features + 2) ** 2 numbers


def _value(h: np.ndarray, c: np.ndarray, lasso: float, w: np.ndarray) -> float:
    return float(w @ h @ w / 2 - c @ w + lasso * np.abs(w).sum())


def _active_set(h: np.ndarray, c: np.ndarray, lasso: float, w: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """The least of w·h·w / 2 - c·w + lasso * |w|, from a start.

    Weights other than 0 form the active set. Their problem is solved with the signs held; a step ends where the value is
    least among its end and the places where a weight becomes 0, which then leaves the set. When all of the set is at rest,
    the weight whose slope exceeds the penalty most enters. Dependent columns make the set's matrix singular: then the step
    goes along the slope that no product explains, up to the place where a weight becomes 0.
    """
    w, scale = w.copy(), max(float(np.abs(c).max(initial=0.0)), 1e-300)
    sign = np.sign(w)
    for _ in range(100 * (len(c) + 1)):
        slope = c - h @ w
        active = np.flatnonzero(sign)
        rest = slope[active] - lasso * sign[active]
        if not len(active) or np.abs(rest).max() <= tolerance * scale:
            outside = np.where(sign == 0, np.abs(slope) - lasso, -np.inf)
            j = int(np.argmax(outside))
            if outside[j] <= tolerance * scale:
                return w
            sign[j] = np.sign(slope[j])
            continue
        size, axes = np.linalg.eigh(h[np.ix_(active, active)])
        along = size > 1e-10 * size[-1]
        flat = axes[:, ~along] @ (axes[:, ~along].T @ rest)
        if np.abs(flat).max() > 1e-6 * lasso:
            step, end = flat, np.inf
        else:
            step, end = axes[:, along] @ (axes[:, along].T @ rest / size[along]), 1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            zero = -w[active] / step
        crossings = np.sort(zero[(zero > 0) & (zero < end)])
        places = [*crossings.tolist(), 1.0] if end == 1.0 else crossings[:1].tolist()
        before, best, reached = _value(h, c, lasso, w), None, np.inf
        for t in places:
            tried = w.copy()
            tried[active] = w[active] + t * step
            tried[active[np.abs(zero - t) <= 1e-12 * max(1.0, t)]] = 0.0
            value = _value(h, c, lasso, tried)
            if value < reached:
                best, reached = tried, value
        if best is None or reached >= before:
            # no step gets lower in floating point: the newest weights go back, which leaves the start
            return w
        w, sign = best, np.sign(best)
    return w


def duality_gap(h: np.ndarray, c: np.ndarray, yy: float, lasso: float, w: np.ndarray) -> float:
    """How far the value at w can lie above the least one, as a share of the label's variance: a certificate that needs no other solver."""
    slope = c - h @ w
    rest, with_label = yy - 2 * c @ w + w @ h @ w, yy - c @ w
    if lasso == 0:
        best = c @ np.linalg.pinv(h, rcond=1e-13, hermitian=True) @ c
        return max(0.0, float(w @ h @ w / 2 - c @ w + best / 2)) / max(yy, 1e-300)
    if rest <= 0:
        return float("inf") if yy > 0 else 0.0
    most = lasso / max(float(np.abs(slope).max(initial=0.0)), 1e-300)
    share = min(max(with_label / rest, -most), most)
    dual = share * with_label - share * share * rest / 2
    return max(0.0, float(_value(h, c, lasso, w) + yy / 2 - dual)) / max(yy, 1e-300)


@dataclass(frozen=True)
class Solution:
    weights: np.ndarray
    intercept: float
    gap: float

    def __iter__(self) -> Iterator:
        return iter((self.weights, self.intercept))


def solve_path(m: Moments, penalties: Sequence[Penalty]) -> list[Solution]:
    """The solution for each penalty: from the strongest down, each one starting where the last ended."""
    h, c, yy = m.products[:-1, :-1] / m.n, m.products[:-1, -1] / m.n, float(m.products[-1, -1] / m.n)
    found: dict[Penalty, Solution] = {}
    w = np.zeros(len(c))
    for p in sorted(set(penalties), key=lambda p: (p.ridge, p.l1_ratio, -p.alpha)):
        lasso = 0.0 if p.ridge else p.alpha * p.l1_ratio
        here = h + np.eye(len(c)) * (p.alpha / m.n if p.ridge else p.alpha * (1 - p.l1_ratio))
        w = _active_set(here, c, lasso, w) if lasso else np.linalg.lstsq(here, c, rcond=1e-13)[0]
        found[p] = Solution(w, float(m.mean[-1] - m.mean[:-1] @ w), duality_gap(here, c, yy, lasso, w))
    return [found[p] for p in penalties]


def solve(products: Sequence[Moments], penalties: Sequence[Penalty]) -> list[Solution]:
    """(weights, intercept) of each problem: moments of its rows, and its penalty."""
    return [solve_path(m, [p])[0] for m, p in zip(products, penalties)]


def squared_error(m: Moments, w: np.ndarray, intercept: float) -> float:
    """Mean squared error of a model on the rows behind the moments."""
    v = np.append(-w, 1.0)
    return float(v @ m.products @ v / m.n + (v @ m.mean - intercept) ** 2)


def grid_search(df: DataFrame, features: Sequence[str], label: str, fold: str, grid: Sequence[Penalty]) -> GridResult:
    """Mean squared error over folds for every penalty; the best is refitted on all rows."""
    return search_moments(moments(df, features, label, fold), features, grid)


def search_moments(per_fold: dict[int, Moments], features: Sequence[str], grid: Sequence[Penalty], most_gap: float = 1e-6) -> GridResult:
    """Every penalty solved without each fold and measured on it. A solution whose gap exceeds ``most_gap`` is an error."""
    errors: dict[Penalty, list[float]] = {p: [] for p in grid}
    gaps: dict[Penalty, float] = dict.fromkeys(grid, 0.0)
    for held_out, there in per_fold.items():
        rest = merged([m for f, m in per_fold.items() if f != held_out])
        for p, found in zip(grid, solve_path(rest, grid)):
            errors[p].append(squared_error(there, found.weights, found.intercept))
            gaps[p] = max(gaps[p], found.gap)
    mean = {p: float(np.mean(e)) for p, e in errors.items()}
    best = min(grid, key=mean.__getitem__)
    [last] = solve_path(merged(list(per_fold.values())), [best])
    gaps[best] = max(gaps[best], last.gap)
    wide = {p: g for p, g in gaps.items() if g > most_gap}
    if wide:
        raise ArithmeticError(f"not solved to a gap of {most_gap}: {wide}")
    model = LinearModel(tuple(features), tuple(float(x) for x in last.weights), last.intercept)
    return GridResult(model, best, mean[best], [(p.alpha, p.l1_ratio, mean[p]) for p in grid], [gaps[p] for p in grid])


ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)


def ridge_grid(alphas: Sequence[float] = ALPHAS) -> list[Penalty]:
    return [Penalty(a, ridge=True) for a in alphas]


def lasso_grid(alphas: Sequence[float] = ALPHAS) -> list[Penalty]:
    return [Penalty(a, 1.0) for a in alphas]


def elastic_grid(alphas: Sequence[float] = ALPHAS, steps: int = 10) -> list[Penalty]:
    return [Penalty(a, i / steps) for a in alphas for i in range(steps + 1)]


def spark_penalty(penalty: Penalty, n: int, label_std: float) -> tuple[float, float]:
    """(regParam, elasticNetParam) that give MLlib's LinearRegression (no standardisation) the same optimum.

    ``label_std`` is the population deviation for the ``normal`` solver and the sample one for ``l-bfgs``.
    """
    if penalty.ridge:
        return penalty.alpha / n * label_std, 0.0
    l1, l2 = penalty.alpha * penalty.l1_ratio, penalty.alpha * (1 - penalty.l1_ratio) * label_std
    return l1 + l2, (l1 / (l1 + l2) if l1 + l2 else 0.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"the fraction at {a}, {b}, {x} does not converge")


def two_sided_p(t: float, freedom: float) -> float:
    """Chance of a value at least this far from 0 under Student's distribution."""
    if math.isinf(t):
        return 0.0
    a, b, x = freedom / 2, 0.5, freedom / (freedom + t * t)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x) if 0 < x < 1 else None
    if log_front is None:
        return 1.0 if x >= 1 else 0.0
    front = math.exp(log_front)
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@dataclass(frozen=True)
class LeastSquares:
    """Weights with their errors, the intercept first, and how well they fit."""

    names: tuple[str, ...]
    weights: np.ndarray
    errors: np.ndarray
    n: float
    freedom: float
    r2: float
    rank: int
    variance: float

    @property
    def adjusted_r2(self) -> float:
        return 1 - (1 - self.r2) * (self.n - 1) / self.freedom

    @property
    def f_value(self) -> float:
        """Explained over unexplained variance; infinite for an exact fit."""
        return self.r2 / self.rank / ((1 - self.r2) / self.freedom) if self.r2 < 1 and self.rank else math.inf


def fit_least_squares(df: DataFrame, features: Sequence[str], label: str) -> LeastSquares:
    """Collinear columns share their weight (minimum-norm solution) instead of failing; their number counts once."""
    m = moments(df, features, label)[0]
    xx, xy, yy = m.products[:-1, :-1], m.products[:-1, -1], m.products[-1, -1]
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    inverse = np.linalg.pinv(xx / np.outer(scale, scale), rcond=1e-11, hermitian=True) / np.outer(scale, scale)
    rank = int(np.linalg.matrix_rank(xx / np.outer(scale, scale), tol=1e-11 * len(xx), hermitian=True))
    w = inverse @ xy
    freedom = float(m.n - 1 - rank)
    unexplained = max(float(yy - w @ xy), 0.0)
    variance = unexplained / freedom
    mean = m.mean[:-1]
    diagonal = np.concatenate([[1 / m.n + mean @ inverse @ mean], np.diag(inverse)])
    weights = np.concatenate([[m.mean[-1] - mean @ w], w])
    r2 = 1 - unexplained / float(yy) if yy > 0 else 0.0
    return LeastSquares(("intercept", *features), weights, np.sqrt(np.maximum(diagonal * variance, 0.0)), m.n, freedom, r2, rank, variance)


def least_squares(df: DataFrame, features: Sequence[str], label: str, level: float = 0.06) -> DataFrame:
    """(feature, coefficient, std_error, t_value, p_value, significant) with an intercept row first."""
    fit = fit_least_squares(df, features, label)
    rows = []
    for name, b, e in zip(fit.names, fit.weights, fit.errors):
        t = float(b / e) if e > 0 else None
        p = two_sided_p(t, fit.freedom) if t is not None else None
        rows.append((name, float(b), float(e), t, p, p is not None and p <= level))
    return df.sparkSession.createDataFrame(
        rows, "feature string, coefficient double, std_error double, t_value double, p_value double, significant boolean"
    )


def fit_summary(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(n, features, r2, adjusted_r2, f_value, residual_error): how well least squares explain the label."""
    fit = fit_least_squares(df, features, label)
    row = (int(fit.n), fit.rank, fit.r2, fit.adjusted_r2, fit.f_value, math.sqrt(fit.variance))
    return df.sparkSession.createDataFrame([row], "n bigint, features int, r2 double, adjusted_r2 double, f_value double, residual_error double")
