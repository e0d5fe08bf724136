"""Linear machines of all classes at once, over random Fourier features that are made anew in each pass.

Spark ML fits one machine after the other and holds a copy of the vectors (8 bytes a component) in memory for each.
Beyond what fits there every step reads them from disk.  Here a pass reads the few features that the components are
made of, makes them block by block in the task and adds up losses and slopes of all machines; the driver has the
coefficients alone.  Objective and steps are those of Spark's LinearSVC: hinge loss over standardised and centred
components, an L2 penalty without the intercept, and an orthant-wise quasi-Newton search (Breeze's OWLQN).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.polynomial import chebyshev, polynomial
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalis import ship_package

#: Rows whose components a task holds at once.
BLOCK = 512
#: Quasi-Newton steps that are remembered, values that the last one is compared with, tries of a line search.
MEMORY, VALUES, TRIES = 10, 20, 20


def _sine(terms: int = 8) -> list[float]:
    """sin(pi r) / r as a polynomial of r * r up to 1/4, by its values at Chebyshev's points; with 8 terms some 1e-15 from it."""
    at = np.cos(np.pi * (np.arange(64) + 0.5) / 64)
    near = chebyshev.cheb2poly(chebyshev.chebfit(at, np.pi * np.sinc(np.sqrt((1 + at) / 8)), terms - 1))
    out = np.zeros(1)
    for c in near[::-1]:  # the points go from -1 to 1, the squares from 0 to 1/4
        out = polynomial.polyadd(polynomial.polymul(out, [-1.0, 8.0]), [c])
    return out[:terms].tolist()


_SINE = _sine()


def halves(t: np.ndarray, out: np.ndarray, square: np.ndarray) -> np.ndarray:
    """(1 - cos(2 pi t)) / 2 into ``out``; ``t`` and ``square`` are overwritten."""
    np.rint(t, out=out)
    np.subtract(t, out, out=t)
    np.multiply(t, t, out=square)
    np.multiply(square, _SINE[-1], out=out)
    for c in _SINE[-2:0:-1]:
        np.add(out, c, out=out)
        np.multiply(out, square, out=out)
    np.add(out, _SINE[0], out=out)
    np.multiply(out, out, out=out)
    return np.multiply(out, square, out=out)


class Maker:
    """Makes (1 - cos(W x + b)) / 2 of a block of rows after the other, each in the place of the one before."""

    def __init__(self, W: np.ndarray, b: np.ndarray) -> None:
        self.turn = np.vstack([W.T, b]) / (2 * math.pi)
        self.room = np.empty((3, BLOCK, len(b)))

    def blocks(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, components) of each block of the features ``x``, the last of them 1."""
        for i in range(0, len(x), BLOCK):
            part = x[i: i + BLOCK]
            t, out, square = self.room[:, : len(part)]
            yield i, halves(np.matmul(part, self.turn, out=t), out, square)


def owlqn(size: int, max_iter: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields where it wants value and slope and is sent both; returns the minimum found from 0."""
    x = np.zeros(size)
    value, slope = yield x
    first, values, steps, i, failed = value, [value], [], 0, False
    if np.linalg.norm(slope) <= max(tolerance * value, 1e-8):
        return x
    while i < max_iter:
        try:
            direction = _direction(slope, steps)
            side = np.where(x != 0, np.sign(x), np.sign(-slope))
            begin, alpha = float(direction @ slope), 1.0 if i else 0.5 / float(np.linalg.norm(slope))
            shrink = 0.5 if i else 0.1
            by = shrink  # Breeze takes the first length for too long, whatever it brings
            for n in range(1, TRIES):
                if not begin < 0 or not 1e-10 <= alpha * by <= 1e10:
                    raise ArithmeticError("no step found")
                alpha *= by
                new = x + direction * alpha
                new = np.where(np.sign(new) == side, new, 0.0)
                at = yield new
                along = float(at[1] @ direction)
                if at[0] > value + alpha * begin * 1e-4:
                    by = shrink
                elif along < 0.9 * begin:
                    by = 2.1
                elif along > -0.9 * begin:
                    by = shrink
                else:
                    break
        except ArithmeticError:
            if failed:
                return x
            failed, steps = True, []
            continue
        failed = False
        steps = [(new - x, at[1] - slope), *steps][:MEMORY]
        x, (value, slope), i = new, at, i + 1
        values = [*values, value][-VALUES:]
        if abs(value - max(values)) <= tolerance * first or np.linalg.norm(slope) <= max(tolerance * value, 1e-8):
            break
    return x


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill by the remembered steps and changes of the slope, where it agrees with the slope."""
    d, shares = slope.copy(), []
    for s, y in steps:
        if not (rho := float(s @ y)) or not math.isfinite(rho):
            raise ArithmeticError("no curvature")
        shares.append(float(s @ d) / rho)
        d -= shares[-1] * y
    if steps:
        s, y = steps[0]
        if s @ y < 0:
            raise ArithmeticError("negative curvature")
        d *= float(s @ y) / float(y @ y)
    for (s, y), a in zip(steps[::-1], shares[::-1], strict=True):
        d += (a - float(y @ d) / float(s @ y)) * s
    d = -d
    return np.where(d * slope < 0, d, 0.0)


def _matrix(columns: Sequence[np.ndarray]) -> np.ndarray:
    return np.column_stack([*columns, np.ones(len(columns[0]))]).astype(np.float64, copy=False)


def packed(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The features (and a 1) and the classes of some thousand rows as the bytes of a matrix and a vector: passes read them as they are."""
    ship_package(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix([batch.column(f).to_numpy(zero_copy_only=False) for f in features])
                if not np.isfinite(x).all():
                    raise ValueError("features must be finite numbers")
                y = batch.column(label).to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], ["x", "y"])

    return df.select(*[F.col(f).cast("double").alias(f) for f in features], label).mapInArrow(pack, "x binary, y binary")


def _sums(rows: DataFrame, W: np.ndarray, b: np.ndarray, what: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """The sums over all blocks of packed rows of what ``what`` says to their components and labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, maker = None, Maker(W, b)
        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer()).reshape(-1, W.shape[1] + 1), np.frombuffer(y.as_buffer())
                for i, h in maker.blocks(x):
                    new = what(h, y[i: i + len(h)])
                    total = new if total is None else [s + t for s, t in zip(total, new, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([t.ravel().tolist() for t in total], pa.list_(pa.float64())), pa.array(range(len(total)), pa.int32())], ["sums", "k"])

    got = rows.mapInArrow(run, "sums array<double>, k int").collect()  # a few numbers a component and task
    return [np.sum([r["sums"] for r in got if r["k"] == k], axis=0) for k in range(1 + max(r["k"] for r in got))]


def fit(rows: DataFrame, classes: int, W: np.ndarray, b: np.ndarray, reg: float, max_iter: int, tolerance: float = 1e-6) -> list[tuple[np.ndarray, float]]:
    """Coefficients and intercept of each class against the rest over the components sqrt(2 / D) cos(W x + b) of ``rows``,
    a table of scaled features and classes (an index) that ``packed`` made."""
    ship_package(rows.sparkSession)
    size = len(b)
    first = np.frombuffer(rows.select(F.substring("x", 1, 8 * (W.shape[1] + 1))).first()[0]).reshape(1, -1)
    near = next(Maker(W, b).blocks(first))[1][0].copy()
    n, s, q = _sums(rows, W, b, lambda h, y: [np.array([float(len(h))]), (h - near).sum(axis=0), ((h - near) ** 2).sum(axis=0)])
    n = float(n[0])
    mean = near + s / n
    std = np.sqrt(np.maximum(q - s * s / n, 0.0) / max(n - 1, 1.0))
    inverse = np.divide(-1.0, std, out=np.zeros(size), where=std > 1e-12)  # scaled, a component is minus its half

    searches = [owlqn(size + 1, max_iter, tolerance) for _ in range(classes)]
    asked, found = {c: next(g) for c, g in enumerate(searches)}, {}
    while asked:
        of = sorted(asked)
        w = np.column_stack([asked[c][:size] * inverse for c in of])
        off = np.array([asked[c][size] for c in of]) - mean @ w
        own = np.array(of, dtype=np.float64)

        def hinge(h: np.ndarray, y: np.ndarray, w: np.ndarray = w, off: np.ndarray = off, own: np.ndarray = own) -> list[np.ndarray]:
            sign = np.where(y[:, None] == own, 1.0, -1.0)
            short = 1.0 - sign * (h @ w + off)
            active = np.where(short > 0, -sign, 0.0)
            return [np.maximum(short, 0.0).sum(axis=0), active.sum(axis=0), h.T @ active]

        loss, active, slopes = _sums(rows, W, b, hinge)
        slopes = slopes.reshape(size, len(of))
        for k, c in enumerate(of):
            x = asked.pop(c)
            slope = np.append((slopes[:, k] - active[k] * mean) * inverse / n + reg * x[:size], active[k] / n)
            try:
                asked[c] = searches[c].send((float(loss[k] / n + 0.5 * reg * (x[:size] @ x[:size])), slope))
            except StopIteration as end:
                found[c] = end.value
    out = []
    for _, x in sorted(found.items()):
        w = x[:size] * inverse
        out.append((w / -2 / math.sqrt(2.0 / size), float(x[size] + (0.5 - mean) @ w)))
    return out


def classified(columns: Sequence[Column], W: np.ndarray, b: np.ndarray, coefficients: np.ndarray, intercepts: np.ndarray) -> Column:
    """The class (an index) whose machine says the most, the first of equals; a row of ``coefficients`` for each."""
    w = coefficients.T * math.sqrt(2.0 / len(b))
    off, w = intercepts + w.sum(axis=0), -2 * w

    @F.pandas_udf("double")
    def best(*x: pd.Series) -> pd.Series:
        made = _matrix([v.to_numpy(np.float64) for v in x])
        if not np.isfinite(made).all():
            raise ValueError("features must be finite numbers, impute missing ones first")
        out = np.empty(len(x[0]))
        for i, h in Maker(W, b).blocks(made):
            out[i: i + len(h)] = (h @ w + off).argmax(axis=1)
        return pd.Series(out)

    return best(*columns)
