"""Whitening of embeddings by incremental eigendecomposition.

Vectors become whole numbers x = floor(scale * c) + shift. The covariance of the distinct x (the fit list) is decomposed without ever
being formed by one task over all rows: each partition keeps a spectrum (eigenvalues, eigenvectors, count, sums) and applies one centred
rank-one update for every vector. An update solves the secular equation 1 + rho * sum(z^2 / (d - mu)) = 0 between its
poles; entries of z that are negligible, and all but one of those that share an eigenvalue, are deflated first. Spectra of
partitions are combined in a tree: the eigenpairs of one and the shift between the two means enter the other as rank-one
updates. A last pass over all rows is a Rayleigh-Ritz step on the basis found: centred rows are projected on it, the small
matrix of their products is summed exactly once more over the partitions, and its eigenvectors turn the basis.

Memory: a task holds one spectrum of width^2 doubles and one batch; a step of a tree holds at most ``FAN`` of them. The driver holds
one. Nothing grows with the rows.

Defined results: rows whose vector is null or holds null or non-finite components are left out; shorter vectors count as
filled with zeros, an empty one too; repeated rows and rows with a null id are rows each on its own, and enter the fit list
once; components are numbered by falling eigenvalue, equal ones in any order; those without variance (eigenvalue at most 1e-12 of the
largest) cannot be whitened and have no rows, so a fit list of one vector gives none; an empty table gives none; other
columns are ignored; a deviation beyond 64 bits ends the job with an error, it never wraps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parcelwatt.llm.common import cut
from parcelwatt.llm.vectors import usable

EPS = np.finfo(float).eps
FAN = 8  # summaries one task combines in a step of a tree
SPECTRUM = "node long, n long, sums array<long>, eigenvalues array<double>, basis array<double>"


def secular_roots(d: np.ndarray, weight: np.ndarray, steps: int = 90) -> tuple[np.ndarray, np.ndarray]:
    """Roots mu of 1 + sum(weight / (d - mu)) = 0 for rising distinct ``d`` and positive weights, and the matrix d[j] - mu[i].

    Root i lies between d[i] and d[i + 1] (the last one at most sum(weight) above d[-1]). It is sought as an offset from the
    nearer pole, so the differences keep their relative accuracy. A step replaces the sums left and right of the root by one pole
    each, with equal value and slope, and solves the quadratic; a step that leaves the bracket is replaced by halving.
    """
    m = len(d)
    rows, last = np.arange(m), m - 1
    gap = np.append(np.diff(d), weight.sum())
    middle = d + gap / 2
    left = 1 + (weight[:, None] / (d[:, None] - middle[None, :])).sum(axis=0) >= 0
    left[last] = True
    origin = np.where(left, rows, np.minimum(rows + 1, last))
    poles = d[:, None] - d[origin][None, :]
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[last] = gap[last]
    offset = (low + high) / 2
    below = rows[:, None] <= rows[None, :]
    after = np.minimum(rows + 1, last)
    for _ in range(steps):
        distance = poles - offset
        term = weight[:, None] / distance
        f = 1 + term.sum(axis=0)
        done = np.abs(f) <= 4 * EPS * m * (1 + np.abs(term).sum(axis=0))
        if done.all():
            break
        low, high = np.where(f < 0, offset, low), np.where(f < 0, high, offset)
        slope = term / distance
        falling = np.where(below, slope, 0).sum(axis=0)
        rising = slope.sum(axis=0) - falling
        a, b = distance[rows, rows], distance[after, rows]
        level = f - a * falling - np.where(rows < last, b * rising, 0)
        s, t = a * a * falling, np.where(rows < last, b * b * rising, 0)
        with np.errstate(all="ignore"):
            middle = level * (a + b) + s + t
            root = np.sqrt(np.maximum(middle * middle - 4 * level * a * b * f, 0))
            step = np.where(middle <= 0, (middle - root) / (2 * level), 2 * a * b * f / (middle + root))
            step[last] = a[last] + s[last] / level[last]
        new = offset + step
        new = np.where((new >= low) & (new <= high), new, (low + high) / 2)
        new = np.where(done, offset, new)
        if (new == offset).all():
            break
        offset = new
    return d[origin] + offset, poles - offset


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (rising eigenvalues, eigenvectors as columns) of basis diag(values) basis' + rho vector vector', rho >= 0."""
    z = basis.T @ vector
    length = float(np.sqrt(z @ z))
    weight = rho * length * length
    if weight == 0:
        return values, basis
    z = z / length
    tolerance = 8 * EPS * max(float(values[-1]), weight)
    # eigenvectors of one eigenvalue are turned so that a single one of them meets the vector
    near = np.flatnonzero(np.diff(values) <= tolerance)
    if len(near):
        basis, z = basis.copy(), z.copy()
        for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):
            group = slice(run[0], run[-1] + 2)
            mirror = z[group].copy()
            size = float(np.sqrt(mirror @ mirror))
            if size == 0:
                continue
            mirror[0] += np.copysign(size, mirror[0])
            basis[:, group] -= np.outer(basis[:, group] @ mirror, mirror * (2 / (mirror @ mirror)))
            head = -np.copysign(size, z[run[0]])
            z[group] = 0
            z[run[0]] = head
    active = weight * np.abs(z) > tolerance
    if not active.any():
        return values, basis
    d, part = values[active], z[active]
    roots, apart = secular_roots(d, weight * part * part)
    # weights for which the roots found are exact keep the eigenvectors orthogonal
    between = d[None, :] - d[:, None]
    np.fill_diagonal(between, 1.0)
    exact = np.sqrt(np.maximum((-apart / between).prod(axis=1), 0))
    turned = np.copysign(exact, part)[:, None] / apart
    turned /= np.sqrt((turned * turned).sum(axis=0))
    values, basis = values.copy(), basis.copy()
    values[active], basis[:, active] = roots, basis[:, active] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Count, sums and scatter (in eigen form) of whole-number vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, np.int64), np.zeros(width), np.eye(width))

    def add(self, x: np.ndarray) -> None:
        if self.n:
            centred = (self.n * x - self.sums) / self.n  # whole numbers up to the division
            self.values, self.basis = rank_one(self.values, self.basis, centred, self.n / (self.n + 1))
        self.n += 1
        self.sums = self.sums + x

    def merge(self, other: Spectrum) -> Spectrum:
        big, small = (self, other) if self.n >= other.n else (other, self)
        values, basis = big.values, big.basis
        for value, vector in zip(small.values, small.basis.T):
            if value > 0:
                values, basis = rank_one(values, basis, vector, float(value))
        if small.n:
            shift = np.array([int(a) * small.n - int(b) * big.n for a, b in zip(big.sums, small.sums)], object)
            shift = np.array([float(s) / (float(big.n) * float(small.n)) for s in shift])
            values, basis = rank_one(values, basis, shift, big.n * small.n / (big.n + small.n))
        return Spectrum(big.n + small.n, big.sums + small.sums, values, basis)

    def row(self, node: int) -> pd.DataFrame:
        return pd.DataFrame({"node": [node], "n": [self.n], "sums": [self.sums], "eigenvalues": [self.values], "basis": [self.basis.ravel()]})

    @classmethod
    def of(cls, row) -> Spectrum:
        sums, values = np.asarray(row["sums"], np.int64), np.asarray(row["eigenvalues"], float)
        return cls(int(row["n"]), sums, values, np.asarray(row["basis"], float).reshape(len(values), len(values)))


def tree(summaries: DataFrame, merge: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str) -> DataFrame:
    """One row from many: rows of one ``node`` number a partition, ``FAN`` neighbours combined in a task until one is left."""
    summaries = cut(summaries)
    nodes = (summaries.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // FAN)

        def step(group: pd.DataFrame) -> pd.DataFrame:
            return merge(group.sort_values("node"), int(group["node"].iloc[0]) // FAN)

        up = summaries.withColumn("up", F.expr(f"node div {FAN}")).repartition(nodes, "up")
        summaries = cut(up.groupBy("up").applyInPandas(lambda group: step(group.drop(columns="up")), schema))
    return summaries


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("node", F.spark_partition_id().cast("long"))


def summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of the arrays in (node, cells), as a flat array; None if there are none."""
    def merge(group: pd.DataFrame, node: int) -> pd.DataFrame:
        return pd.DataFrame({"node": [node], "cells": [np.sum([np.asarray(c, float) for c in group["cells"]], axis=0)]})

    top = tree(parts, merge, "node long, cells array<double>").first()
    return None if top is None else np.array(top["cells"], float)


def scaled(vector: str, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(shift).cast("long"))


def whole_numbers(vectors: DataFrame, key: str, vector: str, scale: int, shift: int) -> tuple[DataFrame, int]:
    """(id, x) of the usable rows with x filled up to the greatest length, and that length."""
    rows = vectors.where(usable(vector)).select(F.col(key).alias("id"), scaled(vector, scale, shift).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), F.greatest(F.lit(width) - F.size("x"), F.lit(0))))
    return rows.select("id", filled.alias("x")), width


def decompose(distinct: DataFrame, width: int) -> Spectrum:
    """Spectrum of the scatter of all rows of ``distinct`` (x), one rank-one update for each."""
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spectrum, node = Spectrum.empty(width), 0
        for batch in batches:
            for x in batch["x"]:
                spectrum.add(np.asarray(x, np.int64))
            node = int(batch["node"].iloc[0]) if len(batch) else node
        if spectrum.n:
            yield spectrum.row(node)

    def merge(group: pd.DataFrame, node: int) -> pd.DataFrame:
        whole = None
        for _, row in group.iterrows():
            part = Spectrum.of(row)
            whole = part if whole is None else whole.merge(part)
        return whole.row(node)

    top = tree(numbered(distinct).mapInPandas(partition, SPECTRUM), merge, SPECTRUM).first()
    return Spectrum.empty(width) if top is None else Spectrum.of(top)


def products(distinct: DataFrame, n: int, sums: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Mean product matrix of the centred rows projected on the columns of ``directions``."""
    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, node = np.zeros((directions.shape[1],) * 2), None
        for batch in batches:
            if len(batch):
                node = int(batch["node"].iloc[0])
                projected = centred(np.stack(batch["x"].to_numpy()), n, sums) @ directions
                cells += projected.T @ projected
        if node is not None:
            yield pd.DataFrame({"node": [node], "cells": [cells.ravel()]})

    cells = summed(numbered(distinct).mapInPandas(partition, "node long, cells array<double>"))
    return cells.reshape(directions.shape[1], -1) / n


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x.astype(np.int64) - sums) / n


@dataclass
class Whitening:
    """What a fit leaves: its size is that of ``components`` vectors."""

    n: int
    sums: np.ndarray
    directions: np.ndarray  # columns, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    turned: float  # greatest off-diagonal product of the basis before the last step, as a share of the trace


def fit(distinct: DataFrame, width: int, components: int) -> Whitening | None:
    """The whitening of the rows of ``distinct`` (x); None if there is no row."""
    spectrum = decompose(distinct, width)
    if not spectrum.n or not width:
        return None
    basis, _ = np.linalg.qr(spectrum.basis[:, ::-1])
    small = products(distinct, spectrum.n, spectrum.sums, basis)
    trace = float(np.trace(small))
    turned = float(np.abs(small - np.diag(np.diag(small))).max()) / trace if trace > 0 else 0.0
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, directions = values[::-1], (basis @ turn)[:, ::-1]
    kept = int((values[:components] > 1e-12 * max(values[0], 0)).sum()) if values[0] > 0 else 0
    values, directions = values[:kept], directions[:, :kept]
    heaviest = np.abs(directions).argmax(axis=0)
    directions = directions * np.where(directions[heaviest, np.arange(kept)] < 0, -1.0, 1.0)
    error = 0.0
    if kept:
        white = products(distinct, spectrum.n, spectrum.sums, directions / np.sqrt(values))
        error = float(np.abs(white - np.eye(kept)).max())
    return Whitening(spectrum.n, spectrum.sums, directions, values, trace, error, turned)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """sum((n x - S)^2) of each row, exact."""
    apart = n * x.astype(np.int64) - sums
    if not len(apart) or float(np.abs(apart).max()) ** 2 * apart.shape[1] < 2.0 ** 62:
        return (apart * apart).sum(axis=1).tolist()
    return [sum(int(a) ** 2 for a in row) for row in apart]


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    rows, width = whole_numbers(vectors, key, vector, scale, shift)
    model = fit(cut(rows.select("x").distinct()), width, components)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], f"`{key}` {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    n, sums, project = model.n, model.sums, model.directions / np.sqrt(model.eigenvalues)

    def project_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, width), np.int64)
            yield pd.DataFrame({"id": batch["id"], "deviation": deviations(x, n, sums), "whitened": list(centred(x, n, sums) @ project)})

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(project_rows, f"id {kind}, deviation long, whitened array<double>")
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    return out.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
