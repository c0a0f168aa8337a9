"""Vectors as ARRAY columns: norm, normalising, products and distances, in double precision."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    length = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: F.when(length > 0, x / length).otherwise(x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def one_thread() -> None:
    """Products of matrices of this process take one thread, as tasks run on every core already; those of OpenBLAS would wait for each other."""
    try:
        with open("/proc/self/maps") as maps:
            paths = {line.split()[-1] for line in maps if "openblas" in line}
        for lib in map(ctypes.CDLL, paths):
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)
    except OSError:  # another system, or another library
        return


def matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """float64[rows, longest] of lists of doubles, and which components are there; the others are 0."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    there = np.arange(lengths.max(initial=0)) < lengths[:, None]
    values, flat = np.zeros(there.shape), lists.flatten()
    values[there] = flat.to_numpy(zero_copy_only=False)
    there[there] = flat.is_valid().to_numpy(zero_copy_only=False)
    values[~there] = 0
    return values, there


class Nearest:
    """The k vectors nearest to each of some questions, of batches that come one after the other.

    A product of matrices gives distances up to a bounded error; pairs that may be among the k nearest by it are
    measured exactly, summed up in the order of the components. What a batch yields are the nearest of it that may be
    among the k nearest of all batches so far. Components that one side lacks don't count; a pair without any in common
    has no distance and comes last. digits: distances that agree in so many decimals are equal.
    """

    QUESTIONS, VECTORS, PAIRS = 512, 4096, 1 << 16

    def __init__(self, questions: pa.Array, k: int, digits: int | None = None):
        self.q, self.there = matrix(questions)
        self.k, self.digits = k, digits
        self.best = np.full((len(self.q), k), np.inf)
        self.longest = 0.0

    @staticmethod
    def _plain(values: np.ndarray, there: np.ndarray) -> np.ndarray:
        return there.all(axis=1) & (np.abs(values) < 1e100).all(axis=1)

    @staticmethod
    def _exact(q: np.ndarray, q_there: np.ndarray, v: np.ndarray, v_there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of rows, and whether they have one."""
        total, any_ = np.zeros(max(len(q), len(v))), np.zeros(max(len(q), len(v)), bool)
        with np.errstate(all="ignore"):
            for j in range(q.shape[1]):
                both, apart = q_there[:, j] & v_there[:, j], q[:, j] - v[:, j]
                total += np.where(both, apart * apart, 0.0)
                any_ |= both
        return total, any_

    def _near(self, rows: slice, v: np.ndarray, there: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, ...]:
        q, q_there = self.q[rows], self.there[rows]
        width = max(q.shape[1], v.shape[1])
        pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        q, q_there, v, there = pad(q), pad(q_there), pad(v), pad(there)
        q_plain, v_plain = self._plain(q, q_there), self._plain(v, there)
        with np.errstate(all="ignore"):
            qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
            rough = q @ v.T
            rough *= -2
            rough += qq[:, None]
            rough += vv
        self.longest = max(self.longest, vv[v_plain].max(initial=0))
        for j in np.flatnonzero(~v_plain):
            d, known = self._exact(q, q_there, v[j : j + 1], there[j : j + 1])
            rough[:, j] = np.where(known & (d == d), d, np.inf)
        for i in np.flatnonzero(~q_plain):
            d, known = self._exact(q[i : i + 1], q_there[i : i + 1], v, there)
            rough[i] = np.where(known & (d == d), d, np.inf)
        both = np.concatenate([self.best[rows], rough], axis=1)
        self.best[rows] = np.partition(both, self.k - 1, axis=1)[:, : self.k]
        error = np.finfo(float).eps * 8 * (width + 4) * (np.where(q_plain, qq, 0) + self.longest)
        most = self.best[rows].max(axis=1) + 2 * error + (0 if self.digits is None else 10.0**-self.digits)
        qi, vi = np.nonzero(rough <= most[:, None])
        found = [self._exact(q[a], q_there[a], v[b], there[b]) for a, b in ((qi[at : at + self.PAIRS], vi[at : at + self.PAIRS]) for at in range(0, len(qi), self.PAIRS))]
        distance, known = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0), np.empty(0, bool))
        key = distance
        if self.digits is not None:
            scale = 10.0**self.digits
            with np.errstate(all="ignore"):
                scaled = np.floor(distance * scale + 0.5) / scale
            key = np.where(np.isfinite(scaled), scaled, distance)
        by = np.lexsort((order[vi], key, ~known, qi))
        qi, vi, key, distance, known = qi[by], vi[by], key[by], distance[by], known[by]
        kept = np.arange(len(qi)) - np.searchsorted(qi, qi, "left") < self.k
        return qi[kept] + rows.start, vi[kept], distance[kept], key[kept], known[kept]

    def batch(self, ids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, ...]:
        """(question, row, distance, rounded distance, whether there is one) of the batch's nearest; ties go to smaller ids."""
        order = np.empty(len(ids), np.int64)
        order[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out = []
        for lo in range(0, len(ids), self.VECTORS):
            v, there = matrix(lists.slice(lo, self.VECTORS))
            for at in range(0, len(self.q), self.QUESTIONS):
                qi, vi, *rest = self._near(slice(at, min(at + self.QUESTIONS, len(self.q))), v, there, order[lo : lo + self.VECTORS])
                out.append((qi, vi + lo, *rest))
        return tuple(np.concatenate(x) for x in zip(*out))
