"""Nodes of a street network inside a cell, as arrays: points are found, rounded and asked for their ways where the pieces lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_Square = tuple[float, float, float, float]
NODE = "x double, y double, pieces long"
_PAIRS = 1 << 16  # pairs of pieces looked at together
_MET = 1 << 20  # pairs of a point and a piece looked at together
_WORK = 1 << 22  # pairs times directions that a square may hold uncut
_LEAST = 16  # halos that a square is wide, at least
_WIDE = float(1 << 31)  # rounded places along a square, at most
_TURNS = 20001  # directions are rounded to 1e-4


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one behind last place of each run of equal values."""
    new = np.append(True, values[1:] != values[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(values))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _crossed(p: np.ndarray, slope: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Where pieces of different directions meet; pieces come in order of their slopes."""
    x1, y1, dx, dy = p[0], p[1], p[2] - p[0], p[3] - p[1]
    for first, last in zip(*_runs(slope)):
        rest = slice(last, len(slope))
        step = max(1, _PAIRS // max(1, len(slope) - last))
        for i in range(first, last if last < len(slope) else first, step):
            a = slice(i, min(i + step, last))
            ax, ay = dx[a, None], dy[a, None]
            turn = ax * dy[rest] - ay * dx[rest]
            gx, gy = x1[rest] - x1[a, None], y1[rest] - y1[a, None]
            t, u = (gx * dy[rest] - gy * dx[rest]) / turn, (gx * ay - gy * ax) / turn
            k, j = np.nonzero((t >= -1e-9) & (t <= 1 + 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9))
            t, k = t[k, j], k + i
            yield x1[k] + t * dx[k], y1[k] + t * dy[k]


def _points(p: np.ndarray, slope: np.ndarray, mine: Callable[[np.ndarray, np.ndarray], np.ndarray], corner: tuple[float, float], side: float, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rounded ends and crossings that belong to a square."""
    base_x, base_y = (np.rint(c * scale) - 1 for c in corner)
    width = int(np.ceil(side * scale)) + 4
    long = (p[0] != p[2]) | (p[1] != p[3])
    found, waiting = np.zeros(0, np.int64), []

    def places() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield p[0], p[1]
        yield p[2], p[3]
        yield from _crossed(p[:, long], slope[long])

    for x, y in places():
        x, y = np.rint(x * scale), np.rint(y * scale)
        own = mine(x / scale, y / scale)
        waiting.append((x[own] - base_x).astype(np.int64) * width + (y[own] - base_y).astype(np.int64))
        if sum(map(len, waiting)) > _MET:
            found, waiting = _distinct(np.concatenate([found, *waiting])), []
    found = _distinct(np.concatenate([found, *waiting]))
    return (found // width + base_x) / scale, (found % width + base_y) / scale


def _met(x: np.ndarray, y: np.ndarray, p: np.ndarray, slope: np.ndarray, corner: tuple[float, float], reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of points and of pieces whose line passes them; per direction, lines are in order of their distance from the corner."""
    for first, last in zip(*_runs(slope)):
        s = slope[first]
        along, up = (0.0, 1.0) if s == np.inf else (1.0 / np.sqrt(1.0 + s * s), s / np.sqrt(1.0 + s * s))
        line = (p[0, first:last] - corner[0]) * up - (p[1, first:last] - corner[1]) * along
        order = np.argsort(line)
        at = (x - corner[0]) * up - (y - corner[1]) * along
        low, high = (np.searchsorted(line[order], at + d, side) for d, side in ((-2 * reach, "left"), (2 * reach, "right")))
        upto = np.cumsum(high - low)
        begin = 0
        while begin < len(x):
            done = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, done + _MET, "right")))
            n = (high - low)[begin:end]
            point = np.repeat(np.arange(begin, end), n)
            yield point, first + order[np.arange(len(point)) - np.repeat(upto[begin:end] - n - done, n) + low[point]]
            begin = end


def _ways(x: np.ndarray, y: np.ndarray, p: np.ndarray, slope: np.ndarray, corner: tuple[float, float], reach: float) -> np.ndarray:
    """How many different directions lead off each point."""
    found, waiting = np.zeros(0, np.int64), []
    for point, piece in _met(x, y, p, slope, corner, reach):
        px, py, (x1, y1, x2, y2) = x[point], y[point], p[:, piece]
        dx, dy = x2 - x1, y2 - y1
        t = np.minimum(1.0, np.maximum(0.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
        gx, gy = px - (x1 + t * dx), py - (y1 + t * dy)
        near = np.sqrt(gx * gx + gy * gy) <= reach
        for ex, ey in ((x1, y1), (x2, y2)):
            vx, vy = (ex - px)[near], (ey - py)[near]
            far = np.sqrt(vx * vx + vy * vy)
            off = far > 2 * reach
            turn_x, turn_y = (np.rint(v[off] / far[off] * 1e4).astype(np.int64) + _TURNS // 2 for v in (vx, vy))
            waiting.append((point[near][off] * _TURNS + turn_x) * _TURNS + turn_y)
        if sum(map(len, waiting)) > _MET:
            found, waiting = _distinct(np.concatenate([found, *waiting])), []
    found = _distinct(np.concatenate([found, *waiting]))
    return np.bincount(found // (_TURNS * _TURNS), minlength=len(x))


def _inside(p: np.ndarray, square: _Square, halo: float) -> np.ndarray:
    """Which pieces come within the halo of a square."""
    x0, y0, x1, y1 = square
    half_x, half_y = (x1 - x0) / 2 + halo, (y1 - y0) / 2 + halo
    gx, gy = (x0 + x1) / 2 - p[0], (y0 + y1) / 2 - p[1]
    dx, dy = p[2] - p[0], p[3] - p[1]
    box = (np.abs(gx - dx / 2) <= half_x + np.abs(dx) / 2) & (np.abs(gy - dy / 2) <= half_y + np.abs(dy) / 2)
    return box & (np.abs(gx * dy - gy * dx) <= half_x * np.abs(dy) + half_y * np.abs(dx))


def square_nodes(p: np.ndarray, slope: np.ndarray, cell: tuple[float, int, int], min_pieces: int, scale: float, reach: float) -> Iterator[tuple[np.ndarray, ...]]:
    """x, y, pieces of the nodes that a cell (side, ix, iy) owns, from all pieces (4 x n, in order of slope) within the halo of it.

    A cell with much to do is quartered, again and again, so that what one square holds stays small.
    """
    step, ix, iy = cell
    halo = 2 * reach
    outer = (ix * step, iy * step, (ix + 1) * step, (iy + 1) * step)
    squares = [(outer, np.arange(len(slope)))]
    while squares:
        square, rows = squares.pop()
        x0, y0, x1, y1 = square
        side = max(x1 - x0, y1 - y0)
        first, last = _runs(slope[rows])
        sizes = (last - first).astype(float)
        pairs = (sizes.sum() ** 2 - (sizes**2).sum()) / 2
        if (pairs * len(sizes) > _WORK and side > _LEAST * halo) or side * scale > _WIDE:
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            for part in ((x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)):
                some = rows[_inside(p[:, rows], part, halo)]
                if len(some):
                    squares.append((part, some))
            continue

        def mine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            own = (np.floor(x / step) == ix) & (np.floor(y / step) == iy)
            for v, k in ((x, 0), (y, 1)):  # the cell's own border is where it says itself
                low, high = square[k], square[k + 2]
                own &= ((v >= low) | (low == outer[k])) & ((v < high) | (high == outer[k + 2]))
            return own

        x, y = _points(p[:, rows], slope[rows], mine, (x0, y0), side, scale)
        long = rows[(p[0, rows] != p[2, rows]) | (p[1, rows] != p[3, rows])]
        if len(x) and len(long):
            pieces = _ways(x, y, p[:, long], slope[long], (x0, y0), reach)
            some = pieces >= min_pieces
            yield x[some], y[some], pieces[some]


def cell_nodes(min_pieces: int, scale: float, reach: float) -> Callable[[pa.Table], pa.Table]:
    """Nodes of some cells, from rows (step, ix, iy, slope, x1, y1, x2, y2) of the pieces within two reaches of them."""

    def nodes(table: pa.Table) -> pa.Table:
        step, ix, iy, slope, *p = (table.column(c).to_numpy() for c in ("step", "ix", "iy", "slope", "x1", "y1", "x2", "y2"))
        order = np.lexsort((slope, iy, ix, step))
        step, ix, iy, slope, p = step[order], ix[order], iy[order], slope[order], np.stack(p)[:, order]
        new = np.append(True, (step[1:] != step[:-1]) | (ix[1:] != ix[:-1]) | (iy[1:] != iy[:-1]))
        first = np.flatnonzero(new)
        found = [(np.zeros(0), np.zeros(0), np.zeros(0, np.int64))]
        with np.errstate(all="ignore"):
            for a, e in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
                found += square_nodes(p[:, a:e], slope[a:e], (float(step[a]), int(ix[a]), int(iy[a])), min_pieces, scale, reach)
        return pa.table({name: np.concatenate([f[k] for f in found]) for k, name in enumerate(("x", "y", "pieces"))})

    return nodes
