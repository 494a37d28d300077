"""The Holt-Winters recursion, in step for many series and parameters, and by blocks of a long series.

State: level l, trend b and a season of m values s. A point y at place t has the error
e = y - l - b - s[t mod m]; then l += b + αe, b += αβe, s[t mod m] += γe.

In step. The arithmetic of a step is the same for all series and all (α, β, γ), so a step is a
handful of operations on arrays (series, parameters).

By blocks. For fixed parameters the state behind a block is an affine function of the state
before it, and the sum of squared errors a quadratic one:

    x' = A x + z,    sse = sse0 + 2 g·x + xᵀQx,    Σe = es0 + r·x

z, sse0 and es0 come from running the block from the zero state, g from running its errors
back through the transposed steps; A, Q and r depend on the block's length only and come from one
season by repeated squaring. So blocks of a series are run side by side, on any number of
tasks, and joined by a product for each block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Smooth:
    """States of series (rows) at parameters (columns): level, trend (s, p), season (s, m, p), and sums of errors."""

    level: np.ndarray
    trend: np.ndarray
    season: np.ndarray
    sse: np.ndarray
    errors: np.ndarray

    @staticmethod
    def zero(series: int, m: int, p: int) -> Smooth:
        return Smooth(*[np.zeros((series, p)) for _ in range(2)], np.zeros((series, m, p)), *[np.zeros((series, p)) for _ in range(2)])

    @staticmethod
    def start(heads: np.ndarray, m: int, p: int) -> Smooth:
        """From the first two seasons of each series (rows): level and season of the first, trend between both."""
        out = Smooth.zero(len(heads), m, p)
        first = heads[:, :m].mean(1)
        out.level[:] = first[:, None]
        out.trend[:] = ((heads[:, m: 2 * m].mean(1) - first) / m)[:, None]
        out.season[:] = (heads[:, :m] - first[:, None])[:, :, None]
        return out

    def vector(self) -> np.ndarray:
        """States as (s, m + 2, p)."""
        return np.concatenate([self.level[:, None], self.trend[:, None], self.season], axis=1)


def run(y: np.ndarray, lengths: np.ndarray, params: np.ndarray, state: Smooth, count_from: int = 0,
        keep: np.ndarray | None = None) -> None:
    """Step ``state`` through the rows of ``y`` (longest series first), all at once.

    ``params``: (s or 1, p, 3). Errors count from place ``count_from`` on; ``keep`` (t, s, p)
    receives every error. Parameters that diverge end with infinite or undefined sums.
    """
    series, m = len(y), state.season.shape[1]
    a, b, g = (np.ascontiguousarray(np.broadcast_to(params[:, :, k], state.level.shape)) for k in range(3))
    ab = a * b
    base, e, tmp = (np.empty(state.level.shape) for _ in range(3))
    # what a step reads lies together
    points, seasons = np.ascontiguousarray(y.T)[:, :, None], state.season.transpose(1, 0, 2).copy()
    k, views = -1, ()
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(len(points)):
            active = series if lengths[-1] > t else int(np.searchsorted(-lengths, -t, "left"))
            if active != k:  # a series has ended
                k = active
                views = tuple(x[:k] for x in (base, e, tmp, state.level, state.trend, state.sse, state.errors, a, ab, g))
                if not k:
                    break
            vb, ve, vt, level, trend, sse, errors, va, vab, vg = views
            s = seasons[t % m, :k]
            np.add(level, trend, out=vb)
            np.subtract(points[t, :k], vb, out=ve)
            ve -= s
            np.multiply(va, ve, out=vt)
            np.add(vb, vt, out=level)
            np.multiply(vab, ve, out=vt)
            trend += vt
            np.multiply(vg, ve, out=vt)
            s += vt
            if t >= count_from:
                np.multiply(ve, ve, out=vt)
                sse += vt
                errors += ve
            if keep is not None:
                keep[t, :k] = ve
    state.season[:] = seasons.transpose(1, 0, 2)


def back(errors: np.ndarray, lengths: np.ndarray, params: np.ndarray, m: int) -> np.ndarray:
    """Σ e_t * ∂e_t/∂x over each block (longest first), x the state (s, m + 2, p) before it."""
    steps, series, p = errors.shape
    a, b, g = (np.ascontiguousarray(np.broadcast_to(params[:, :, k], (series, p))) for k in range(3))
    ab, down, tmp = a * b, np.empty((series, p)), np.empty((series, p))
    out = np.zeros((m + 2, series, p))
    with np.errstate(over="ignore", invalid="ignore"):
        for t in range(steps - 1, -1, -1):
            k = series if lengths[-1] > t else int(np.searchsorted(-lengths, -t, "left"))
            level, trend, s, vd, vt = out[0, :k], out[1, :k], out[2 + t % m, :k], down[:k], tmp[:k]
            np.multiply(a[:k], level, out=vd)
            np.multiply(ab[:k], trend, out=vt)
            vd += vt
            np.multiply(g[:k], s, out=vt)
            vd += vt
            vd += errors[t, :k]
            level -= vd
            trend += level
            s -= vd
    return out.transpose(1, 0, 2)


@dataclass
class Homogeneous:
    """How the state alone acts over a number of points: A, Q (p, d, d) and r (p, d)."""

    a: np.ndarray
    q: np.ndarray
    r: np.ndarray

    @staticmethod
    def steps(params: np.ndarray, m: int, n: int) -> Homogeneous:
        """Of ``n`` points (up to a season) from a season's begin. ``params``: (p, 3)."""
        d, p = m + 2, len(params)
        unit = np.broadcast_to(np.eye(d)[:, :, None], (d, d, p)).copy()
        state = Smooth(unit[:, 0].copy(), unit[:, 1].copy(), unit[:, 2:].copy(), *[np.zeros((d, p)) for _ in range(2)])
        kept = np.zeros((n, d, p))
        run(np.zeros((d, n)), np.full(d, n), params[None], state, 0, kept)
        h = kept.transpose(2, 0, 1)
        return Homogeneous(state.vector().transpose(2, 1, 0), h.transpose(0, 2, 1) @ h, h.sum(1))

    def then(self, other: Homogeneous) -> Homogeneous:
        t = self.a.transpose(0, 2, 1)
        return Homogeneous(other.a @ self.a, self.q + t @ other.q @ self.a, self.r + (other.r[:, None] @ self.a)[:, 0])

    @staticmethod
    def points(params: np.ndarray, m: int, n: int) -> Homogeneous:
        """Of any number of points, by squaring that of a season."""
        with np.errstate(over="ignore", invalid="ignore"):
            out, rest = None, n // m
            power = Homogeneous.steps(params, m, m) if rest else None
            while rest:
                if rest & 1:
                    out = power if out is None else out.then(power)
                rest >>= 1
                if rest:
                    power = power.then(power)
            if n % m:
                tail = Homogeneous.steps(params, m, n % m)
                out = tail if out is None else out.then(tail)
            return out


def padded(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays as rows of one matrix, the longest first, their lengths, and their order."""
    sizes = np.array([len(x) for x in arrays])
    by = np.argsort(-sizes, kind="stable")
    out = np.zeros((len(arrays), int(sizes.max())))
    for i, k in enumerate(by):
        out[i, : sizes[k]] = arrays[k]
    return out, sizes[by], by
