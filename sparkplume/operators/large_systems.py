"""Kriging systems of many places: conjugate gradients over places that neighbouring targets share.

Targets of a small area have most of their places in common, and the system of a target is the part of the covariances of
all of them that belongs to its own places. All right sides of all targets advance together. The square of the places is in
memory for a few thousand places only: beyond, places lie in square tiles. Tiles that no covariance reaches never meet, tiles
far apart meet through a grid of nodes in each, and the others place by place, a few at a time.
Whatever does not converge is reported, and the caller solves it directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import inf, isqrt

import numpy as np

SAMPLE = 128  # places that stand for the smooth part of the covariances in the preconditioner
STEPS = 100  # of the iteration at least; a system of n places is as cheap to solve directly after about n / 12
RESIDUAL = 1e-12  # of each right side, relative to it
BAND = 2**16  # covariances formed at a time
DENSE = 8_000  # places whose covariances are kept as one matrix
FEW = 1_024  # places for which tiles do not pay
KEPT = 2**25  # covariances of tiles that are kept for the next step; more are formed anew
DROPPED = 1e-12  # what covariances that are left out may add up to for a place, whose own variance is one
FAR = 1e-11  # the same for the errors of covariances between nodes
NODES = ((8, 24), (6, 40))  # nodes of a tile and tiles, in each direction, to choose from
NO_PRECONDITIONER = 0.5  # sum of the other covariances of a place up to which the nugget alone is near enough

Smooth = Callable[[np.ndarray], np.ndarray]


def _distances(x: np.ndarray, y: np.ndarray, to_x: np.ndarray, to_y: np.ndarray) -> np.ndarray:
    dx, dy = x[:, None] - to_x[None, :], y[:, None] - to_y[None, :]
    dx *= dx
    dy *= dy
    dx += dy
    return np.sqrt(dx, out=dx)


def _covariances(smooth: Smooth, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Covariances among all places, one on the diagonal."""
    n = len(x)
    out = np.empty((n, n))
    step = max(1, BAND // n)
    for s in range(0, n, step):
        e = min(n, s + step)
        band = smooth(_distances(x[s:e], y[s:e], x[s:], y[s:]))
        out[s:e, s:] = band
        out[e:, s:e] = band[:, e - s :].T
    np.fill_diagonal(out, 1.0)
    return out


def _nodes(count: int) -> np.ndarray:
    """Nodes of an interval from -1 to 1."""
    return np.cos(np.pi * (np.arange(count) + 0.5) / count)


def _basis(at: np.ndarray, count: int) -> np.ndarray:
    """Weights of the nodes of an interval for places from -1 to 1 in it."""
    waves = [np.cos(np.arange(1, count) * np.arccos(np.clip(v, -1.0, 1.0))[:, None]) for v in (at, _nodes(count))]
    return (1.0 + 2.0 * waves[0] @ waves[1].T) / count


def _between(
    smooth: Smooth, side: float, rows: np.ndarray, cols: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """Covariances (offset, at, at) from places ``at`` x ``at`` of a tile to those of the tile so many rows and columns before."""
    step = (at[:, None] - at[None, :]) * side / 2
    dy = rows[:, None, None] * side + step
    dx = cols[:, None, None] * side + step
    h = np.hypot(dy[:, :, None, :, None], dx[:, None, :, None, :])
    return smooth(h).reshape(len(rows), len(at) ** 2, len(at) ** 2)


class Covariances:
    """Products of the covariances of all places with vectors.

    ``smooth(h)`` falls with the distance; it is zero beyond ``edge``, where it may have a kink.
    """

    def __init__(self, smooth: Smooth, x: np.ndarray, y: np.ndarray, edge: float = inf):
        self.n, self.smooth = len(x), smooth
        extent = max(np.ptp(x), np.ptp(y), 1e-9)
        h = np.linspace(0.0, 1.5 * extent, 4097)
        felt = np.flatnonzero(smooth(h) * self.n > DROPPED)
        reach = h[min(felt[-1] + 1, len(h) - 1)] if len(felt) else 0.0
        self.plain = not len(felt)  # nugget alone
        self.matrix: np.ndarray | None = None
        short = reach < extent / 4
        if self.plain:
            return
        if self.n <= FEW or self.n <= DENSE and not short:
            self.matrix = _covariances(smooth, x, y)
            return
        self.far: np.ndarray | None = None
        reach, near = min(edge, reach), None
        if short:
            near = self._lay(x, y, min(int(2 * extent / reach), isqrt(self.n // 8)), reach)
        if near is None or self._pairs(near) > KEPT:
            self._lay_far(x, y, edge, reach, near)
        else:
            self._meet_near(near)

    def _lay(self, x: np.ndarray, y: np.ndarray, count: int, reach: float) -> np.ndarray:
        """Deal the places over tiles; says for tiles so many rows and columns apart whether covariances reach."""
        self.count = max(1, count)
        self.side = max(np.ptp(x), np.ptp(y), 1e-9) / self.count * (1 + 1e-9)
        col, row = (((v - v.min()) / self.side).astype(int) for v in (x, y))
        tile = row * self.count + col
        self.order = np.argsort(tile, kind="stable")
        self.tile, self.x, self.y = tile[self.order], x[self.order], y[self.order]
        self.start = np.searchsorted(self.tile, np.arange(self.count**2 + 1))
        apart = np.arange(self.count)
        least = np.hypot(*np.meshgrid(*[np.maximum(apart - 1, 0)] * 2)) * self.side
        return least < reach

    def _pairs(self, near: np.ndarray) -> int:
        """Covariances of places in tiles that are near."""
        g = self.count
        waves = np.fft.rfft2(np.diff(self.start).reshape(g, g), s=(2 * g, 2 * g))
        pairs = np.fft.irfft2(np.abs(waves) ** 2, s=(2 * g, 2 * g))
        every = np.zeros((2 * g, 2 * g), dtype=bool)
        for up in (1, -1):
            for right in (1, -1):
                every[np.ix_(up * np.arange(g), right * np.arange(g))] = near
        return int(round(pairs[every].sum()))

    def _lay_far(self, x: np.ndarray, y: np.ndarray, edge: float, reach: float, near: np.ndarray | None) -> None:
        """Tiles that meet through nodes where these are good enough, in the way that leaves fewest pairs of places."""
        best = None if near is None else (self._pairs(near), self.count, 0, near, None)
        for nodes, count in NODES:
            near = self._lay(x, y, min(count, isqrt(self.n // 16)), reach)
            rows, cols = (v.ravel() for v in np.indices(near.shape))
            most = np.hypot(rows + 1, cols + 1) * self.side
            least = np.hypot(np.maximum(rows - 1, 0), np.maximum(cols - 1, 0)) * self.side
            smoothly = near.ravel() & (np.maximum(rows, cols) > 1) & ((most < edge) | (least > edge))
            at = np.flatnonzero(smoothly)
            wrong = self._errors(nodes, rows[at], cols[at]) * np.diff(self.start).max()
            least_first = np.argsort(wrong, kind="stable")
            at = at[least_first[4 * np.cumsum(wrong[least_first]) <= FAR]]  # up to four tiles are so far apart
            near.ravel()[at] = False
            if best is None or self._pairs(near) < best[0]:
                best = (self._pairs(near), self.count, nodes, near, at)
        _, count, nodes, near, at = best
        self._lay(x, y, count, reach)
        self._meet_near(near)
        if nodes and len(at):
            self._meet_far(nodes, at // count, at % count)

    def _errors(self, count: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Largest error of covariances through nodes, at places spread over both tiles."""
        tried = np.linspace(-1.0, 1.0, 6)
        part = np.kron(_basis(tried, count), _basis(tried, count))
        given = part @ _between(self.smooth, self.side, rows, cols, _nodes(count)) @ part.T
        return np.abs(given - _between(self.smooth, self.side, rows, cols, tried)).max(axis=(1, 2), initial=0.0)

    def _meet_far(self, nodes: int, rows: np.ndarray, cols: np.ndarray) -> None:
        """Covariances between nodes depend on how far tiles are apart only: their product is a convolution over tiles."""
        g = self.count
        found = _between(self.smooth, self.side, rows, cols, _nodes(nodes)).reshape(len(rows), *[nodes] * 4)
        kernel = np.zeros((2 * g, 2 * g, nodes**2, nodes**2))
        for up in (1, -1):
            for right in (1, -1):
                # nodes are symmetric in their tile: turning the offset turns their order
                turned = found[:, ::up, ::right, ::up, ::right]
                kernel[up * rows, right * cols] = turned.reshape(len(rows), nodes**2, nodes**2)
        self.far = np.fft.rfft2(kernel, axes=(0, 1))
        by_row, by_col = (
            _basis(2 * ((v - v.min()) / self.side - at) - 1, nodes)
            for v, at in ((self.y, self.tile // g), (self.x, self.tile % g))
        )
        self.weights = (by_row[:, :, None] * by_col[:, None, :]).reshape(self.n, -1)

    def _meet_near(self, near: np.ndarray) -> None:
        g, start = self.count, self.start
        spans = []  # (rows apart, first and last column apart) of tiles that meet
        for apart in np.flatnonzero(near.any(axis=1)):
            line = np.concatenate([[False], near[apart, :0:-1], near[apart], [False]]).astype(int)
            change = np.diff(line)
            for a, b in zip(np.flatnonzero(change == 1) - (g - 1), np.flatnonzero(change == -1) - g):
                spans += [(s * apart, a, b) for s in ((1, -1) if apart else (1,))]
        self.meet = []  # (first and last place of a tile, those it meets)
        for tile in np.flatnonzero(np.diff(start)):
            row, col = divmod(int(tile), g)
            met = []
            for apart, a, b in sorted(spans):
                if 0 <= row + apart < g and col + b >= 0 and col + a < g:
                    first = (row + apart) * g
                    s, e = start[first + max(col + a, 0)], start[first + min(col + b, g - 1) + 1]
                    if e > s:
                        met.append((int(s), int(e)))
            self.meet.append((int(start[tile]), int(start[tile + 1]), met))
        size = sum((e - s) * sum(b - a for a, b in met) for s, e, met in self.meet)
        self.kept = list(self._blocks()) if size <= KEPT else None

    def _blocks(self) -> Iterator[tuple[int, int, list[tuple[int, int]], np.ndarray]]:
        for s, e, met in self.meet:
            to_x, to_y = (np.concatenate([v[a:b] for a, b in met]) for v in (self.x, self.y))
            before = 0
            for a, b in met:
                if a <= s < b:
                    own = before + s - a
                before += b - a
            step = max(1, BAND // len(to_x))
            for first in range(s, e, step):
                last = min(e, first + step)
                block = self.smooth(_distances(self.x[first:last], self.y[first:last], to_x, to_y))
                block[np.arange(last - first), own + np.arange(first - s, last - s)] = 1.0
                yield first, last, met, block

    def times(self, v: np.ndarray) -> np.ndarray:
        """``v`` (places, any number of vectors)."""
        if self.plain:
            return v.copy()
        if self.matrix is not None:
            return self.matrix @ v
        v = v[self.order]
        out = np.zeros_like(v)
        tile, met_v = None, None
        for s, e, met, block in self.kept if self.kept is not None else self._blocks():
            if met is not tile:
                tile, met_v = met, np.concatenate([v[a:b] for a, b in met])
            out[s:e] = block @ met_v
        if self.far is not None:
            for s in range(0, v.shape[1], 16):
                out[:, s : s + 16] += self._times_far(v[:, s : s + 16])
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def _times_far(self, v: np.ndarray) -> np.ndarray:
        g, filled = self.count, np.flatnonzero(np.diff(self.start))
        sums = np.zeros((g * g, self.weights.shape[1], v.shape[1]))
        for t in filled:
            s, e = self.start[t], self.start[t + 1]
            sums[t] = self.weights[s:e].T @ v[s:e]
        wide = (2 * g, 2 * g)
        waves = self.far @ np.fft.rfft2(sums.reshape(g, g, *sums.shape[1:]), s=wide, axes=(0, 1))
        sums = np.fft.irfft2(waves, s=wide, axes=(0, 1))[:g, :g].reshape(sums.shape)
        out = np.empty_like(v)
        for t in filled:
            s, e = self.start[t], self.start[t + 1]
            out[s:e] = self.weights[s:e] @ sums[t]
        return out


def _sample(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Places spread over the area: strips by x, ordered by y, and every so many of them."""
    strips = np.array_split(np.argsort(x, kind="stable"), max(1, round(size**0.5)))
    order = np.concatenate([s[np.argsort(y[s], kind="stable")] for s in strips])
    return order[np.linspace(0, len(x) - 1, size).astype(int)]


def _smooth_part(smooth: Smooth, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``q`` such that ``q @ q.T`` is the part of the covariances that a sample of the places explains."""
    at = np.unique(_sample(x, y, min(SAMPLE, len(x))))
    root, axes = np.linalg.eigh(smooth(_distances(x[at], y[at], x[at], y[at])))
    keep = (root > 0) & (root > 1e-6 * root.max())
    return smooth(_distances(x, y, x[at], y[at])) @ (axes[:, keep] / np.sqrt(root[keep]))


def solve_together(
    smooth: Smooth, x: np.ndarray, y: np.ndarray, member: np.ndarray, rhs: np.ndarray, edge: float = inf
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solutions, products with the covariances, and a flag per target that all its right sides converged.

    ``smooth(h)`` is the covariance at a distance without the nugget, in units in which a place has variance one, and zero
    beyond ``edge``. ``member`` (targets, places) marks the places of each target; ``rhs`` (places, targets, sides) is zero elsewhere.
    """
    n, targets, sides = rhs.shape
    cov = Covariances(smooth, x, y, edge)
    inside = np.ascontiguousarray(member.T[:, :, None], dtype=float)

    def times(v: np.ndarray, mine: np.ndarray) -> np.ndarray:
        return cov.times(v.reshape(n, -1)).reshape(v.shape) * mine

    if cov.plain or cov.times(np.ones((n, 1))).max() - 1 <= NO_PRECONDITIONER:

        def approximate(v: np.ndarray, live: np.ndarray, mine: np.ndarray) -> np.ndarray:
            return v

    else:
        q = _smooth_part(smooth, x, y)
        rest = np.maximum(1.0 - (q * q).sum(axis=1), 1e-4)
        q /= np.sqrt(rest)[:, None]
        inner = np.empty((targets, q.shape[1], q.shape[1]))
        for t in range(targets):
            own = q[member[t]]
            inner[t] = np.linalg.inv(np.eye(q.shape[1]) + own.T @ own)
        scale = np.sqrt(rest)[:, None, None]

        def approximate(v: np.ndarray, live: np.ndarray, mine: np.ndarray) -> np.ndarray:
            u = v / scale
            low = (q.T @ u.reshape(n, -1)).reshape(q.shape[1], len(live), sides).transpose(1, 0, 2)
            low = (inner[live] @ low).transpose(1, 0, 2).reshape(q.shape[1], len(live) * sides)
            u -= (q @ low).reshape(u.shape) * mine
            u /= scale
            return u

    out, ok = np.zeros_like(rhs), np.zeros(targets, dtype=bool)
    limit = RESIDUAL * np.sqrt((rhs * rhs).sum(axis=0))
    live, broken = np.arange(targets), np.zeros(targets, dtype=bool)
    mine, sol, res = inside, np.zeros_like(rhs), rhs.copy()
    way, before = np.zeros_like(rhs), np.ones((targets, sides))
    for _ in range(max(STEPS, n // 12) + 1):
        done = np.sqrt((res * res).sum(axis=0)) <= limit[live]
        solved = done.all(axis=1)
        left = ~solved & ~broken
        if not left.all():
            out[:, live], ok[live] = sol, solved
            live, mine, sol, res, way = live[left], mine[:, left], sol[:, left], res[:, left], way[:, left]
            done, before = done[left], before[left]
        if not len(live):
            break
        near = approximate(res, live, mine)
        now = (res * near).sum(axis=0)
        way = near + way * (now / before)
        before = np.where(now > 0, now, 1.0)
        ahead = times(way, mine)
        bend = (way * ahead).sum(axis=0)
        broken = (~(bend > 0) & ~done).any(axis=1)  # a bounded linear model may be no covariance: not solved here
        step = np.where(done | broken[:, None], 0.0, now / np.where(bend > 0, bend, 1.0))
        sol += way * step
        res -= ahead * step
    return out, times(out, inside), ok
