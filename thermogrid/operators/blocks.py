"""Nearest features for blocks of query points: queries that lie together are pruned together, and searched in one go.

What a block has to look at follows from its corners. For a feature's point g and a point p of another feature, the difference of
squared distances from q is linear in q, so if g is farther than p from every corner of a box, it is so from all points in the box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from thermogrid import constants as K

_CHUNK = 1 << 16  # rows in order that are cut into blocks together
_PAIRS = 1 << 15  # distances worked out at once
_SLACK = 1e-9


def cut_blocks(size: int):
    """Rows (query id, qx, qy, ...) that come in order along a curve get a column `block`: at most `size` points, halved along the longer axis."""

    def halves(x: np.ndarray, y: np.ndarray, at: np.ndarray, out: list[np.ndarray]) -> None:
        if len(at) <= size:
            out.append(at)
            return
        axis = x if np.ptp(x[at]) >= np.ptp(y[at]) else y
        order = at[np.argsort(axis[at], kind="stable")]
        middle = len(order) // 2
        halves(x, y, order[:middle], out)
        halves(x, y, order[middle:], out)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held, rows = [], 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            x, y = (table.column(c).to_numpy() for c in ("qx", "qy"))
            found: list[np.ndarray] = []
            halves(x, y, np.arange(table.num_rows), found)
            numbers = np.concatenate([np.full(len(b), number + i) for i, b in enumerate(found)])
            number += len(found)
            out = table.take(pa.array(np.concatenate(found))).append_column("block", pa.array(numbers, pa.int64()))
            yield from out.to_batches(max_chunksize=10_000)

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= _CHUNK:
                yield from blocks()
                held, rows = [], 0
        if held:
            yield from blocks()

    return cut


def _placed(x: np.ndarray, y: np.ndarray, sphere: bool) -> np.ndarray:
    """Positions as rows: (x, y), or on the sphere in metres from its centre, where straight lines are as long as arcs in order."""
    if not sphere:
        return np.column_stack([x, y])
    lon, lat = np.radians(x), np.radians(y)
    return K.EARTH_RADIUS_M * np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


class _Spots:
    """Features' places (points, or pieces from a to b) and how many features each has."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cnt: np.ndarray, k: int):
        self.a, self.way, self.cnt, self.k = a, b - a, cnt, k
        length = (self.way * self.way).sum(axis=1)
        self.points = not length.any()
        self.per = np.where(length > 0, 1.0 / np.where(length > 0, length, 1.0), 0.0)
        self.eps = 1e-12 * max(float(np.abs(a).max(initial=0.0)), float(np.abs(b).max(initial=0.0)), 1.0)

    def nearest_points(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """On each place, the point nearest to q."""
        if self.points:
            return self.a[at]
        t = np.clip(((q - self.a[at]) * self.way[at]).sum(axis=1) * self.per[at], 0.0, 1.0)
        return self.a[at] + t[:, None] * self.way[at]

    def distances(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances, a row a query."""
        out = np.zeros((len(q), len(at)))
        gaps = [q[:, None, d] - self.a[None, at, d] for d in range(q.shape[1])]
        if not self.points:
            t = np.clip(sum(g * self.way[None, at, d] for d, g in enumerate(gaps)) * self.per[None, at], 0.0, 1.0)
            gaps = [g - t * self.way[None, at, d] for d, g in enumerate(gaps)]
        for g in gaps:
            out += g * g
        return out

    def in_reach(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the places `at`, those that can be one of the k nearest of a point in the box around q."""
        low, high = q.min(axis=0), q.max(axis=0)
        middle = (low + high) / 2
        on = self.nearest_points(middle, at)
        far = ((on - middle) ** 2).sum(axis=1)
        some = np.argpartition(far, self.k - 1)[: self.k] if len(at) > self.k else np.arange(len(at))
        some = some[np.argsort(far[some], kind="stable")]
        have = np.cumsum(self.cnt[at[some]])
        if have[-1] < self.k:
            return at
        pivots = on[some[: int(np.searchsorted(have, self.k)) + 1]]
        keep = np.zeros(len(at), bool)
        for way in np.ndindex(*([2] * len(low))):
            corner = np.where(way, high, low)
            limit = np.sqrt(((pivots - corner) ** 2).sum(axis=1).max()) * (1 + _SLACK) + self._noise(corner)
            keep |= self.distances(corner[None, :], at)[0] <= limit * limit
        return at[keep]

    def _noise(self, q: np.ndarray) -> float:
        return self.eps + 1e-12 * float(np.abs(q).max()) + 1e-9

    def candidates(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of every place that holds one of a query's k nearest features, and hardly any other."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(len(q)), np.arange(len(self.a)))]
        while todo:
            qi, at = todo.pop()
            if len(qi) > 16 and len(qi) * len(at) > _PAIRS:
                axis = int(np.argmax(np.ptp(q[qi], axis=0)))
                order = qi[np.argsort(q[qi, axis], kind="stable")]
                todo += [(half, self.in_reach(q[half], at)) for half in np.array_split(order, 2)]
                continue
            step = max(1, 8 * _PAIRS // max(len(at), 1))
            for i in range(0, len(qi), step):
                part = qi[i : i + step]
                d = np.sqrt(self.distances(q[part], at))
                limit = self._limits(d, self.cnt[at]) * (1 + 1e-12) + self._noise(q[part])
                row, column = np.nonzero(d <= limit[:, None])
                out.append((part[row], at[column]))
        return tuple(np.concatenate([o[k] for o in out]) for k in (0, 1))

    def _limits(self, d: np.ndarray, cnt: np.ndarray) -> np.ndarray:
        if self.k == 1:
            return d.min(axis=1)
        near = np.argpartition(d, self.k - 1, axis=1)[:, : self.k] if d.shape[1] > self.k else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
        have = np.cumsum(cnt[near], axis=1)
        last = np.argmax(have >= self.k, axis=1)
        found = np.take_along_axis(np.take_along_axis(d, near, axis=1), last[:, None], axis=1)[:, 0]
        return np.where(have[:, -1] >= self.k, found, np.inf)


def search_block(k: int, sphere: bool, query_columns: list[str], spot_columns: list[str]):
    """For one block: its queries beside every place that holds one of their k nearest features."""

    def search(queries: pa.Table, spots: pa.Table) -> pa.Table:
        if not queries.num_rows or not spots.num_rows:
            return pa.Table.from_arrays(
                [queries.column(c).slice(0, 0) for c in query_columns] + [spots.column(c).slice(0, 0) for c in spot_columns], query_columns + spot_columns)
        value = lambda t, c: t.column(c).to_numpy()
        a = _placed(value(spots, "x1"), value(spots, "y1"), sphere)
        b = a if sphere else _placed(value(spots, "x2"), value(spots, "y2"), False)
        found = _Spots(a, b, value(spots, "cnt"), k).candidates(_placed(value(queries, "qx"), value(queries, "qy"), sphere))
        left, right = (pa.array(f) for f in found)
        columns = [queries.column(c).combine_chunks().take(left) for c in query_columns] + [spots.column(c).combine_chunks().take(right) for c in spot_columns]
        return pa.Table.from_arrays(columns, query_columns + spot_columns)

    return search


def reach_leaf(probes: list[str], sphere: bool, spot_columns: list[str]):
    """For one leaf: the blocks that look at it, each beside the spots that one of its points may need.

    A block's probes are points (columns x, y) with a limit (l): its corners, or its middle on the sphere. No limit keeps every spot.
    """

    def reach(pairs: pa.Table, spots: pa.Table) -> pa.Table:
        value = lambda t, c: t.column(c).to_numpy()
        a = _placed(value(spots, "x1"), value(spots, "y1"), sphere)
        b = a if sphere else _placed(value(spots, "x2"), value(spots, "y2"), False)
        leaf, every = _Spots(a, b, np.ones(len(a), np.int64), 1), np.arange(len(a))
        block, spot = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, 8 * _PAIRS // max(len(a), 1))
        for i in range(0, pairs.num_rows, step):
            part = pairs.slice(i, step)
            keep = np.zeros((part.num_rows, len(a)), bool)
            for p in probes:
                limit = value(part, f"{p}l").astype(float)
                if sphere:
                    limit = 2 * K.EARTH_RADIUS_M * np.sin(np.minimum(limit / (2 * K.EARTH_RADIUS_M), np.pi / 2)) * (1 + _SLACK) + 1e-6
                near = leaf.distances(_placed(value(part, f"{p}x"), value(part, f"{p}y"), sphere), every) <= (limit * limit)[:, None]
                keep |= near | np.isnan(limit)[:, None]
            row, column = np.nonzero(keep)
            block.append(row + i)
            spot.append(column)
        columns = [pairs.column("block").combine_chunks().take(pa.array(np.concatenate(block)))]
        columns += [spots.column(c).combine_chunks().take(pa.array(np.concatenate(spot))) for c in spot_columns]
        return pa.Table.from_arrays(columns, ["block", *spot_columns])

    return reach
