"""Exact k nearest neighbours between two tables, partitioned by Spark.

The population is cut into cells by a k-d tree that is grown from a hashed sample, beyond ``FAN`` cells by a tree of parents
and one inside each parent. The index is a table (cell, parent, box of the rows' features) that is joined, so cells grow with
the rows without a limit. A query visits its home cell first. Then the distance to the boxes drops parents, then cells; what
is left is visited in order of its lower bound, four times as many cells each time, and what the bound found so far rules
out by then is dropped. Vectors of more than ``NARROW`` features, whose boxes bound little, go to cells around two levels of
pivots instead, and the triangle inequality drops them.

Several feature subspaces (views) share one index: a cell has a box or a radius under every view, and a query's lower bounds
and bounds found so far are kept per view. Where queries meet a block of rows, the rows are laid out in k-d order under each view
and cut into groups of small leaves; a query goes through groups, and in them through leaves, in order of the lower bound of
their boxes and stops where that bound is above its k-th distance, all queries of a block side by side. Vectors of more than ``NARROW`` features are multiplied as matrices instead (under
l1, the gaps of a feature once for all views), and the few rows near a view's k-th distance are then measured exactly.

Cells are cut into blocks of bounded size on both sides, so a task holds two small blocks and returns k rows per query:
candidate pairs are never emitted, and a cell (or a group of copies) of any size is spread over many tasks. Identical
vectors are reduced to one row with their k smallest ids on the population side and to one weighted row on the query side
before anything is routed.
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform
from veiltab.operators.joins import attach_groups
from veiltab.session import materialize

BLOCK_ROWS = 65536     # rows per block of the population, fewer for wide vectors
BLOCK_VALUES = 1 << 19  # numbers a block aims at
CELL_ROWS = 32768      # rows aimed at per cell
FAN = 256              # cells up to which one tree is grown; beyond, parents are cut first
SAMPLE = 64            # rows per cell a tree is grown from
OPEN_ROWS = 8192       # queries per task that looks for open cells
NARROW = 24            # features up to which leaves are worth their boxes
GROUP = 256            # rows per group of leaves
LEAF = 16              # rows per leaf
FIRST_LEAVES = 4       # leaves a query measures first; each later step measures STEP times as many
ASK_BLOCKS = 128       # pairs of blocks a search aims at
ASK_ROWS = (1024, 32768)  # queries per block, at least and at most: a block of rows is laid out once for each block of queries
VIEW_BLOCKS = 192      # pairs of blocks below which the views are dealt out over several tasks
MOST_TASKS = 1024      # tasks that pairs of blocks are dealt out over, at most
ASK_HITS = 1 << 21     # hits a block of queries may have under all views
FIRST_CELLS = 4        # cells visited after home; each later step visits STEP times as many
STEP = 4
KERNEL_VALUES = 1 << 19  # doubles a task holds for one stretch of queries
LEAF_VALUES = 1 << 16  # the same where leaves are searched: what a processor's cache holds
DIGITS = 9             # distances are compared at this precision, ties by id
SLACK = 1e-6           # of lower bounds, for rounding
NO_ID = -(1 << 63)     # stands for a null id

VECTOR = "num array<double>, cat array<bigint>, w array<double>"
FOUND = "part string, q bigint, qid bigint, mult bigint, bound array<double>, view array<int>, rank array<int>, id array<bigint>, dist array<double>"  # hits of a query


@dataclass(frozen=True)
class View:
    """A feature subspace: positions in ``num`` and in ``cat``."""
    name: str
    num: tuple[int, ...]
    cat: tuple[int, ...]


@dataclass
class Visits:
    """What a search looked at: tables of ``part, cell, n, nq`` (rows of the cell, queries that visited it)."""
    steps: list[DataFrame] = field(default_factory=list)

    def pairs(self) -> int:
        return sum(s.agg(F.sum(F.col("n") * F.col("nq"))).first()[0] or 0 for s in self.steps)


class Vectors:
    """Vectors of a block: numbers, category codes and the weight of the own level."""

    def __init__(self, pdf: pd.DataFrame):
        n = len(pdf)
        self.num = np.stack(pdf["num"].to_numpy()).astype(float).reshape(n, -1)
        self.cat = np.stack(pdf["cat"].to_numpy()).astype(np.int64).reshape(n, -1)
        self.w = np.stack(pdf["w"].to_numpy()).astype(float).reshape(n, -1)

    def take(self, rows) -> Vectors:
        out = object.__new__(Vectors)
        out.num, out.cat, out.w = self.num[rows], self.cat[rows], self.w[rows]
        return out

    def __len__(self) -> int:
        return len(self.num)

    def lengths(self, view: View) -> np.ndarray:
        total = np.zeros(len(self))
        for i in view.num:
            total += self.num[:, i] ** 2
        for j in view.cat:
            total += self.w[:, j] ** 2
        return np.sqrt(total) + 1e-12


class Metric:
    """l1, l2 or cosine (l2 between vectors of length 1) under each view, with weighted category mismatch."""

    def __init__(self, name: str, views: list[View], n_num: int, n_cat: int):
        if name not in ("l1", "l2", "cosine"):
            raise ValueError(name)
        self.name, self.views, self.n_num = name, views, n_num
        self.matrix = np.zeros((len(views), n_num + n_cat))
        for v, view in enumerate(views):
            self.matrix[v, list(view.num)] = 1.0
            self.matrix[v, [n_num + j for j in view.cat]] = 1.0

    def exact(self, v: int, q: Vectors, a: Vectors) -> np.ndarray:
        """Distance of each vector of ``q`` to the one of ``a`` in the same place, features in their order."""
        view, out = self.views[v], np.zeros(len(q))
        nq, na = (q.lengths(view), a.lengths(view)) if self.name == "cosine" else (1.0, 1.0)
        for i in view.num:
            gap = q.num[:, i] / nq - a.num[:, i] / na
            out += np.abs(gap) if self.name == "l1" else gap * gap
        for j in view.cat:
            x, y = q.w[:, j] / nq, a.w[:, j] / na
            same = q.cat[:, j] == a.cat[:, j]
            out += np.where(same, np.abs(x - y), x + y) if self.name == "l1" else np.where(same, (x - y) ** 2, x * x + y * y)
        return out if self.name == "l1" else np.sqrt(out)

    def near(self, q: Vectors, a: Vectors) -> np.ndarray:
        """All distances (view, query, row), in another order of addition: right but for the last digits."""
        if self.name != "l1":
            return self._by_products(q, a)
        parts = np.empty((self.matrix.shape[1], len(q), len(a)))
        for i in range(self.n_num):
            x, y = q.num[:, i, None], a.num[None, :, i]
            np.abs(x - y, out=parts[i])
        for j in range(self.matrix.shape[1] - self.n_num):
            x, y, same = q.w[:, j, None], a.w[None, :, j], q.cat[:, j, None] == a.cat[None, :, j]
            parts[self.n_num + j] = np.where(same, np.abs(x - y), x + y)
        return (self.matrix @ parts.reshape(len(parts), -1)).reshape(len(self.views), len(q), len(a))

    def _by_products(self, q: Vectors, a: Vectors) -> np.ndarray:
        """Square roots of |q|^2 + |a|^2 - 2 q a, of vectors of length 1 under cosine."""
        out = np.empty((len(self.views), len(q), len(a)))
        for v, view in enumerate(self.views):
            (x, c, w), (y, d, u) = self.under(v, q), self.under(v, a)
            out[v] = x @ y.T
            for j in range(w.shape[1]):
                out[v] += np.where(c[:, j, None] == d[None, :, j], w[:, j, None] * u[None, :, j], 0.0)
            own = ((x ** 2).sum(axis=1) + (w ** 2).sum(axis=1))[:, None] + ((y ** 2).sum(axis=1) + (u ** 2).sum(axis=1))[None, :]
            out[v] = np.sqrt(np.maximum(own - 2.0 * out[v], 0.0))
        return out

    def under(self, v: int, x: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, codes and weights of a view, of length 1 under cosine."""
        view = self.views[v]
        length = x.lengths(view)[:, None] if self.name == "cosine" else 1.0
        return x.num[:, list(view.num)] / length, x.cat[:, list(view.cat)], x.w[:, list(view.cat)] / length

    def margin(self, distance: np.ndarray, q: Vectors, a: Vectors) -> np.ndarray:
        """How far above a distance of :meth:`near` its equals at ``DIGITS`` digits may lie."""
        lost = 2e-9
        if self.name != "l1":  # products cancel: a millionth part of the longest vector is far above what they lose
            lost += 1e-6 * (1.0 if self.name == "cosine" else max(np.sqrt((x.num ** 2).sum(axis=1) + (x.w ** 2).sum(axis=1)).max(initial=0.0) for x in (q, a)))
        return distance + lost + 1e-11 * np.abs(np.where(np.isfinite(distance), distance, 0.0))

    def stretch(self, rows: int) -> int:
        """Queries to work on at a time; only l1 holds the gaps of every feature."""
        held = sum(self.matrix.shape) if self.name == "l1" else len(self.views) + 2
        return max(1, KERNEL_VALUES // (held * max(rows, 1)))


def _leaves(num: np.ndarray, cat: np.ndarray, w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in k-d order, first and end place of each leaf, first leaf of each group.

    Rows are cut along the widest feature down to groups of ``GROUP`` rows, equal values and levels staying on one side, then
    all groups at once are halved down to leaves of ``size`` rows.
    """
    order, firsts, todo = np.arange(len(num)), [], [(0, len(num))]
    while todo:
        start, end = todo.pop()
        if end - start <= GROUP:
            firsts.append(start)
            continue
        rows, cut = order[start:end], (end - start) // 2
        codes = cat[rows]
        apart = np.where((codes != codes[0]).any(axis=0), 2.0 * np.abs(w[rows]).max(axis=0), 0.0)
        width = np.concatenate([np.nan_to_num(np.ptp(num[rows], axis=0)), apart])
        if len(width) and width.max() > 0:
            widest = int(width.argmax())
            key = num[rows, widest] if widest < num.shape[1] else codes[:, widest - num.shape[1]]
            middle = np.partition(key, cut)[cut]
            below, upto = key < middle, key <= middle
            left = below if upto.all() or (below.any() and cut - below.sum() <= upto.sum() - cut) else upto
            order[start:end], cut = np.concatenate([rows[left], rows[~left]]), int(left.sum())
        todo += [(start + cut, end), (start, start + cut)]
    levels = [np.unique(cat[:, j], return_inverse=True)[1].astype(float) for j in range(cat.shape[1])]
    keys = np.column_stack([num, *levels]) if cat.shape[1] else num
    firsts = starts = np.array(firsts, dtype=np.int64)
    sizes = np.diff(starts, append=len(order))
    while keys.shape[1] and (sizes > size).any():
        node = np.repeat(np.arange(len(starts)), sizes)
        codes, heavy = cat[order], np.abs(w[order])
        apart = np.where(np.minimum.reduceat(codes, starts, axis=0) != np.maximum.reduceat(codes, starts, axis=0), 2.0 * np.maximum.reduceat(heavy, starts, axis=0), 0.0)
        lo, hi = _box(num[order], starts)
        widest = np.concatenate([np.nan_to_num(hi - lo), apart], axis=1).argmax(axis=1)
        order = order[np.lexsort((keys[order, widest[node]], node))]
        starts = np.sort(np.concatenate([starts, (starts + sizes // 2)[sizes > size]]))
        sizes = np.diff(starts, append=len(order))
    if not keys.shape[1]:
        starts = np.arange(0, len(order), size)
        firsts = starts[:1]
    return order, starts, np.append(starts[1:], len(order)), np.searchsorted(starts, firsts)


def _box(columns: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.fmin.reduceat(columns, starts, axis=0), np.fmax.reduceat(columns, starts, axis=0)


def _boxes(a, starts: np.ndarray):
    """Per run of rows from each start: least and greatest number, weight and code of every feature, feature by feature."""
    return [[x.T.copy() for x in pair] for pair in (_box(a[0], starts), _box(a[2], starts), (np.minimum.reduceat(a[1], starts, axis=0), np.maximum.reduceat(a[1], starts, axis=0)))]


def _low(metric: Metric, q, at: np.ndarray, boxes, box: np.ndarray) -> np.ndarray:
    """Lower bounds of the distance of vectors ``at`` to any row of the ``box`` in the same place; both places are broadcast."""
    squared, out = metric.name != "l1", np.zeros(np.broadcast_shapes(at.shape, box.shape))

    def gap(x, lo, hi):
        away = np.maximum(lo[box] - x, x - hi[box])
        np.maximum(away, 0.0, out=away)
        return np.multiply(away, away, out=away) if squared else away

    (lo, hi), (least, most), (first, last) = boxes
    for i in range(q[0].shape[1]):
        out += gap(q[0][at, i], lo[i], hi[i])
    for j in range(q[1].shape[1]):
        x, same = q[2][at, j], gap(q[2][at, j], least[j], most[j])
        other = x * x + np.maximum(np.maximum(least[j], -most[j]), 0.0)[box] ** 2 if squared else x + least[j][box]
        single, inside = (first[j] == last[j])[box], (q[1][at, j] >= first[j][box]) & (q[1][at, j] <= last[j][box])
        out += np.where(inside, np.where(single, same, np.minimum(same, other)), other)
    return np.nan_to_num(np.sqrt(out) if squared else out, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _measure(metric: Metric, q, at: np.ndarray, leaves, leaf: np.ndarray) -> np.ndarray:
    """Distances of vectors ``at`` to the rows of the ``leaf`` in the same place, features in the order of :meth:`Metric.exact`."""
    num, cat, w, blank = leaves
    out = np.zeros((len(at), LEAF))
    for i, x in enumerate(num):
        gap = q[0][at, i, None] - x[leaf]
        out += np.abs(gap, out=gap) if metric.name == "l1" else np.multiply(gap, gap, out=gap)
    for j, codes in enumerate(cat):
        x, y, same = q[2][at, j, None], w[j][leaf], q[1][at, j, None] == codes[leaf]
        out += np.where(same, np.abs(x - y), x + y) if metric.name == "l1" else np.where(same, (x - y) ** 2, x * x + y * y)
    out = out if metric.name == "l1" else np.sqrt(out, out=out)
    out[blank[leaf]] = np.nan
    return out


def _first_k(k: int, iq: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query by (distance, id), and their places."""
    order = np.lexsort((ids, dist, iq))
    iq, dist, ids = iq[order], dist[order], ids[order]
    place = np.arange(len(iq)) - np.searchsorted(iq, iq)
    hit = place < k
    return iq[hit], dist[hit], ids[hit], place[hit]


def _reach(limit: np.ndarray) -> np.ndarray:
    """Lower bounds up to here may hide a row within the limit."""
    return np.where(np.isfinite(limit), limit + SLACK * (1.0 + np.abs(limit)), np.inf)


def _hits_by_leaves(metric: Metric, v: int, k: int, queries: Vectors, rows: Vectors, ids: np.ndarray, bounds: np.ndarray):
    """``query, id, distance`` of the k nearest rows within the bounds, under one view: groups by lower bound, in them leaves by lower bound."""
    q, a = metric.under(v, queries), metric.under(v, rows)
    may = np.flatnonzero(_low(metric, q, np.arange(len(queries)), _boxes(a, np.zeros(1, np.int64)), np.zeros(1, np.int64)) <= _reach(bounds))
    if not len(may):  # closed for all queries under this view
        return may, np.empty(0, ids.dtype), np.empty(0)
    q, bounds = [x[may] for x in q], bounds[may]
    order, starts, ends, firsts = _leaves(*a, LEAF)
    a = [x[order] for x in a]
    place = starts[:, None] + np.arange(LEAF)
    blank, place = place >= ends[:, None], np.minimum(place, len(order) - 1)
    leaves = [[x[:, i][place] for i in range(x.shape[1])] for x in a] + [blank]
    fine, coarse, inside = _boxes(a, starts), _boxes(a, starts[firsts]), np.diff(firsts, append=len(starts))
    table, stretch, parts, every = ids[order][place], max(1, LEAF_VALUES // max(len(firsts), FIRST_LEAVES * LEAF)), [], np.arange(len(firsts))[None, :]
    for start in range(0, len(may), stretch):
        mine = [x[start:start + stretch] for x in q]
        limit, found = bounds[start:start + stretch].copy(), (np.empty(0, np.int64), np.empty(0), np.empty(0, ids.dtype))
        low = _low(metric, mine, np.arange(len(limit))[:, None], coarse, every)
        nearest = np.argsort(low, axis=1)
        low, done, step = np.take_along_axis(low, nearest, axis=1), 0, 1
        while done < low.shape[1]:
            iq, at = np.nonzero(low[:, done:done + step] <= _reach(limit)[:, None])
            if not len(iq):
                break
            for some in range(0, len(iq), LEAF_VALUES // LEAF):
                asked, group = iq[some:some + LEAF_VALUES // LEAF], nearest[iq[some:some + LEAF_VALUES // LEAF], done + at[some:some + LEAF_VALUES // LEAF]]
                n = inside[group]
                asked, leaf = np.repeat(asked, n), np.repeat(firsts[group] - np.cumsum(n) + n, n) + np.arange(n.sum())
                bound = _low(metric, mine, asked, fine, leaf)
                near = bound <= _reach(limit)[asked]
                asked, leaf, bound = asked[near], leaf[near], bound[near]
                by = np.lexsort((bound, asked))
                asked, leaf, bound = asked[by], leaf[by], bound[by]
                rank, first, more = np.arange(len(asked)) - np.searchsorted(asked, asked), 0, FIRST_LEAVES
                while first <= rank.max(initial=-1):
                    hit = (rank >= first) & (rank < first + more)
                    hit[hit] = bound[hit] <= _reach(limit)[asked[hit]]
                    for chunk in np.split(np.flatnonzero(hit), np.arange(LEAF_VALUES // LEAF, hit.sum(), LEAF_VALUES // LEAF)):
                        found = _best_of(metric, k, mine, asked[chunk], leaves, leaf[chunk], table, limit, found)
                    first, more = first + more, more * STEP
            done, step = done + step, step * STEP
        parts.append((may[start + found[0]], found[2], found[1]))
    return [np.concatenate(x) for x in zip(*parts)]


def _best_of(metric: Metric, k: int, q, near: np.ndarray, leaves, leaf: np.ndarray, table: np.ndarray, limit: np.ndarray, found):
    """The first k of each query so far, with the rows of the leaves added; lowers ``limit``."""
    if not len(near):
        return found
    dist = _measure(metric, q, near, leaves, leaf)
    if k < LEAF:  # k rows of one leaf bound the k-th distance of all
        np.fmin.at(limit, near, np.round(np.partition(dist, k - 1, axis=1)[:, k - 1], DIGITS))
    pair, row = np.nonzero(dist <= (limit + 2e-9 + 1e-11 * np.abs(np.where(np.isfinite(limit), limit, 0.0)))[near, None])
    exact, asked = np.round(dist[pair, row], DIGITS), near[pair]
    hit = exact <= limit[asked]
    *found, rank = _first_k(k, *[np.concatenate(x) for x in zip(found, (asked[hit], exact[hit], table[leaf[pair[hit]], row[hit]]))])
    full = rank == k - 1
    limit[found[0][full]] = np.minimum(limit[found[0][full]], found[1][full])
    return found


def _hits_by_products(metric: Metric, k: int, queries: Vectors, rows: Vectors, ids: np.ndarray, bounds: np.ndarray):
    """``view, query, id, distance`` of the k nearest rows within the bounds: all rows are compared."""
    step = metric.stretch(len(rows))
    for start in range(0, len(queries), step):
        some = queries.take(slice(start, start + step))
        near, bound = metric.near(some, rows), bounds[start:start + step]
        for v in range(len(metric.views)):
            kth = np.partition(near[v], k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(some), np.inf)
            iq, ia = np.nonzero(near[v] <= metric.margin(np.minimum(kth, bound[:, v]), some, rows)[:, None])
            dist = np.round(metric.exact(v, some.take(iq), rows.take(ia)), DIGITS)
            hit = dist <= bound[iq, v]
            iq, dist, found, _ = _first_k(k, iq[hit], dist[hit], ids[ia[hit]])
            yield v, start + iq, found, dist


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists one after the other, and the length of each list."""
    lists = t.column(name).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _vectors(t: pa.Table) -> Vectors:
    out = object.__new__(Vectors)
    out.num, out.cat, out.w = [_flat(t, c)[0].astype(kind, copy=False).reshape(len(t), -1) if len(t) else np.empty((0, 0), kind)
                               for c, kind in (("num", float), ("cat", np.int64), ("w", float))]
    return out


def _packed(k: int, n_views: int, asked: pa.Table, at: np.ndarray, view: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> pa.Table:
    """Per query of ``asked`` that has hits its first k under every view (by view, distance, id), with the bounds they set."""
    key, dist, ids, place = _first_k(k, at * n_views + view, dist, ids)
    at, view = np.divmod(key, n_views)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    bound, full = np.full((len(first), n_views), np.inf), place == k - 1
    bound[np.searchsorted(at[first], at[full]), view[full]] = dist[full]
    ends = pa.array(np.append(first, len(at)), pa.int32())
    columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * n_views, pa.int32()), pa.array(bound.ravel(), pa.float64()))]
    columns += [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((view, pa.int32()), (place + 1, pa.int32()), (ids, pa.int64()), (dist, pa.float64()))]
    names = ["part", "q", "qid", "mult"]
    return pa.table([*[x.combine_chunks() for x in asked.select(names).take(pa.array(at[first], pa.int64())).columns], *columns], names=[*names, "bound", "view", "rank", "id", "dist"])


def _best_rows(metric: Metric, k: int, chunks: int = 1):
    """k nearest rows of a population block for every query of a query block, under each view of the chunk that is still open."""
    def run(q: pa.Table, a: pa.Table) -> pa.Table:
        parts: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(a) and len(q):
            rows, queries, (lists, sizes) = _vectors(a), _vectors(q), _flat(a, "ids")
            by = np.argsort(a.column("id").to_numpy(), kind="stable")  # hits are places in this order
            ids = np.empty(len(a), np.int64)
            ids[by] = np.arange(len(a))
            copies, flat, first = sizes[by], lists, (np.cumsum(sizes) - sizes)[by]
            bounds = _flat(q, "bound")[0].reshape(len(q), -1)
            if metric.matrix.shape[1] <= NARROW:
                found = ((v, *_hits_by_leaves(metric, v, k, queries, rows, ids, bounds[:, v])) for v in range(q.column("_v")[0].as_py(), len(metric.views), chunks))
            else:
                found = _hits_by_products(metric, k, queries, rows, ids, bounds)
            for v, at, hits, dist in found:
                if len(at) and copies.max() > 1:  # rows behind k copies of nearer ones are out
                    by = np.lexsort((dist, at))
                    at, hits, dist = at[by], hits[by], dist[by]
                    before, tied = np.cumsum(copies[hits]) - copies[hits], np.r_[True, (np.diff(at) != 0) | (np.diff(dist) != 0)]
                    mine = before[np.searchsorted(at, at)]
                    near = before[np.flatnonzero(tied)[np.cumsum(tied) - 1]] - mine < k
                    at, hits, dist = at[near], hits[near], dist[near]
                n = copies[hits]
                at, dist, hits = np.repeat(at, n), np.repeat(dist, n), flat[np.repeat(first[hits] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                if len(n) and n.max() > 1:
                    at, dist, hits, _ = _first_k(k, at, dist, hits)
                parts.append((at, np.full(len(at), v), hits, dist))
        return _packed(k, len(metric.views), q, *[np.concatenate(x) for x in zip(*parts)])
    return run


def _merge(k: int, n_views: int):
    """Several lists of hits of a query become one, queries of a block side by side."""
    def run(found: pa.Table) -> pa.Table:
        _, first, at = np.unique(found.column("q").to_numpy(), return_index=True, return_inverse=True)
        (view, n), (ids, _), (dist, _) = [_flat(found, c) for c in ("view", "id", "dist")]
        return _packed(k, n_views, found.take(pa.array(first, pa.int64())), np.repeat(at, n), view.astype(np.int64), ids, dist)
    return run


def _nearest(metric: Metric, whole: Metric):
    """Nearest pivot of each row of a block (whole space), with the distance under every view."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "pivot": [], "far": [], "gaps": []})
        right = right.sort_values("pivot")
        pivots, rows, out = Vectors(right), Vectors(left), []
        step = whole.stretch(len(right))
        for start in range(0, len(left), step):
            some = rows.take(slice(start, start + step))
            best = whole.near(some, pivots)[0].argmin(axis=1)
            chosen = pivots.take(best)
            gaps = np.stack([metric.exact(v, some, chosen) for v in range(len(metric.views))], axis=1)
            out.append(pd.DataFrame({"id": left["id"].to_numpy()[start:start + step], "pivot": right["pivot"].to_numpy()[best],
                                     "far": whole.exact(0, some, chosen), "gaps": gaps.tolist()}))
        return pd.concat(out, ignore_index=True)
    return run


def _open(metric: Metric):
    """Pivots whose rows may be within the bound of a query under some view: the lower bounds, and the least lead on the bound."""
    def run(q: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        columns: dict[str, list] = {c: [] for c in ("q", "pivot", "lead", "low")}
        if len(q) and len(pivots):
            queries, at, radius = Vectors(q), Vectors(pivots), np.stack(pivots["radius"].to_numpy()).astype(float)
            bounds, home = np.stack(q["bound"].to_numpy()).astype(float), q["home"].to_numpy()  # no home among parents
            step = metric.stretch(len(pivots))
            for start in range(0, len(q), step):
                low = metric.near(queries.take(slice(start, start + step)), at) - radius.T[:, None, :]
                lead = (low - bounds[start:start + step].T[:, :, None]).min(axis=0)
                open_ = (lead <= SLACK) & (home[start:start + step, None] != pivots["pivot"].to_numpy()[None, :])
                iq, ia = np.nonzero(open_)
                columns["q"].append(q["q"].to_numpy()[start + iq])
                columns["pivot"].append(pivots["pivot"].to_numpy()[ia])
                columns["lead"].append(lead[iq, ia])
                columns["low"].extend(low[:, iq, ia].T.tolist())
        return pd.DataFrame({c: (pd.Series(x, dtype=object) if c == "low" else np.concatenate(x) if x else []) for c, x in columns.items()})
    return run


def _blocks(left: DataFrame, right: DataFrame, keys: list[str], block_rows: int, left_rows: int | None = None) -> DataFrame:
    """Blocks that :func:`_meet` cuts both sides of every key into, and how often a row of the left side meets a block."""
    def sizes(df: DataFrame, name: str, rows: int) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))

    return materialize(sizes(left, "_ln", left_rows or block_rows).join(sizes(right, "_rn", block_rows), keys).select(
        *keys, "_ln", "_rn", (F.col("_ln_rows") * F.col("_rn")).alias("meetings")), "meet")


def _meet(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, block_rows: int, left_rows: int | None = None,
          both: DataFrame | None = None, tasks: int | None = None):
    """Both sides of every key cut into blocks of bounded size, each block of one side beside each of the other; ``tasks`` deals them out."""
    both = (_blocks(left, right, keys, block_rows, left_rows) if both is None else both).select(*keys, "_ln", "_rn")

    def cut(df: DataFrame, own: str, other: str, row_id: str, mine: str, theirs: str) -> DataFrame:
        placed = attach_groups(df, both, keys, "inner")
        blocks = placed.withColumn(mine, F.pmod(F.xxhash64(row_id), F.col(own)).cast("int")).withColumn(
            theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return blocks.select(*[F.col(x).alias(x) for x in [*df.columns, mine, theirs]])  # new columns: both sides may come from one table

    on = [*keys, "_l", "_r"]
    sides = cut(left, "_ln", "_rn", left_id, "_l", "_r"), cut(right, "_rn", "_ln", right_id, "_r", "_l")
    left, right = [x.repartition(tasks, *on) for x in sides] if tasks else sides
    return left.groupBy(*on).cogroup(right.groupBy(*on))


class _Index:
    """Two-level pivot index over ``rows(part, id, num, cat, w)``; every table of it is written."""

    def __init__(self, rows: DataFrame, sizes: DataFrame, metric: Metric, whole: Metric, block_rows: int):
        self.metric, self.whole, self.block_rows = metric, whole, block_rows
        draw = uniform("pivot", "id")
        sized = attach_groups(rows, sizes, ["part"], "inner")
        is_first = F.col("id") == F.col("first_id")
        pivots = materialize(sized.filter((draw * F.col("n") < F.col("cells")) | is_first).select(
            "part", F.col("id").alias("pivot"), "num", "cat", "w", ((draw * F.col("n") < F.sqrt(F.col("cells"))) | is_first).alias("is_parent")), "pivots")
        top = pivots.filter("is_parent").drop("is_parent")
        parent_of = self.nearest(pivots.withColumnRenamed("pivot", "id"), top, ["part"])
        children = materialize(pivots.drop("is_parent").join(parent_of.select(F.col("id").alias("pivot"), F.col("pivot").alias("parent")), "pivot"), "pivots")
        in_parent = materialize(self.nearest(rows, top, ["part"]).select("id", F.col("pivot").alias("parent"), F.col("gaps").alias("parent_gaps")), "parents")
        in_cell = self.nearest(rows.join(in_parent.select("id", "parent"), "id"), children, ["part", "parent"])
        self.rows = materialize(rows.join(in_parent, "id").join(in_cell.select("id", F.col("pivot").alias("cell"), "gaps"), "id"), "cells")
        self.cells = materialize(self._radii(["part", "parent", "cell"], "gaps").join(
            children.select("part", F.col("pivot").alias("cell"), "num", "cat", "w"), ["part", "cell"]).withColumnRenamed("cell", "pivot"), "cell-index")
        self.parents = materialize(self._radii(["part", "parent"], "parent_gaps").withColumnRenamed("parent", "pivot").join(top, ["part", "pivot"]), "parent-index")

    def _radii(self, keys: list[str], gaps: str) -> DataFrame:
        widest = F.array(*[F.max(F.col(gaps)[v]) for v in range(len(self.metric.views))])
        return self.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), widest.alias("radius"))

    def nearest(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """``id, pivot, gaps``: nearest of ``right`` per row of ``left``, ties to the smaller pivot."""
        met = _meet(left.select(*keys, "id", "num", "cat", "w"), right.select(*keys, "pivot", "num", "cat", "w"), keys, "id", "pivot", self.block_rows, max(self.block_rows, ASK_ROWS[0]))
        found = met.applyInPandas(_nearest(self.metric, self.whole), "id bigint, pivot bigint, far double, gaps array<double>")
        return found.groupBy("id").agg(F.min(F.struct("far", "pivot", "gaps")).alias("b")).select("id", "b.pivot", "b.gaps")

    def homes(self, queries: DataFrame) -> DataFrame:
        """Queries with their home cell."""
        asked = queries.withColumn("id", F.col("q"))
        parent = self.nearest(asked, self.parents, ["part"]).select("id", F.col("pivot").alias("parent"))
        return self.nearest(asked.join(parent, "id"), self.cells, ["part", "parent"]).select(F.col("id").alias("q"), F.col("pivot").alias("home")).join(queries, "q")

    def open_cells(self, queries: DataFrame) -> DataFrame:
        """``q, cell, low, place`` of ``queries(.., home, bound)``: cells that cannot be ruled out, by lower bound."""
        schema = "q bigint, pivot bigint, lead double, low array<double>"
        asked = queries.select("part", "q", "num", "cat", "w", "bound", "home")
        parents = _meet(asked.withColumn("home", F.lit(None).cast("double")), self.parents.select("part", "pivot", "num", "cat", "w", "radius"),
                        ["part"], "q", "pivot", self.block_rows, max(self.block_rows, ASK_ROWS[0])).applyInPandas(_open(self.metric), schema)
        routed = materialize(parents.select("q", F.col("pivot").alias("parent")).join(asked, "q"), "open-parents")
        cells = _meet(routed, self.cells.select("part", "parent", "pivot", "num", "cat", "w", "radius"), ["part", "parent"], "q", "pivot", self.block_rows, max(self.block_rows, ASK_ROWS[0]))
        order = Window.partitionBy("q").orderBy("lead", "cell")
        found = cells.applyInPandas(_open(self.metric), schema).withColumnRenamed("pivot", "cell")
        return found.withColumn("place", F.row_number().over(order))


def _grow(whole: Metric, keys: list[str]):
    """A k-d tree of ``fan`` leaves from a sample: feature, cut and both ends of every node; leaf n ends at -1 - n."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        num, cat, w = whole.under(0, Vectors(pdf))
        nodes, ends, leaves = [], [], 0
        todo = [(np.arange(len(pdf)), int(pdf["fan"].iloc[0]), None)]
        while todo:
            rows, fan, above = todo.pop()
            codes, at = cat[rows], None
            apart = np.where((codes != codes[0]).any(axis=0), 2.0 * np.abs(w[rows]).max(axis=0), 0.0)
            width = np.concatenate([np.nan_to_num(np.ptp(num[rows], axis=0)), apart])
            if fan > 1 and len(width) and width.max() > 0:
                widest, cut = int(width.argmax()), len(rows) // 2
                key = num[rows, widest] if widest < num.shape[1] else codes[:, widest - num.shape[1]]
                middle = np.partition(key, cut)[cut]
                below, upto = key < middle, key <= middle
                left = below if upto.all() or (below.any() and cut - below.sum() <= upto.sum() - cut) else upto
                at = key[left].max()
                nodes.append((widest, float(at) if widest < num.shape[1] else 0.0, 0 if widest < num.shape[1] else int(at)))
                ends.append([0, 0])
                some = min(max(round(fan * left.sum() / len(rows)), 1), fan - 1)
                todo += [(rows[left], some, (len(nodes) - 1, 0)), (rows[~left], fan - some, (len(nodes) - 1, 1))]
            if above is not None:
                ends[above[0]][above[1]] = len(nodes) - 1 if at is not None else -1 - leaves
            leaves += at is None
        feature, cuts, levels = zip(*nodes) if nodes else ((), (), ())
        below, beyond = zip(*ends) if ends else ((), ())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "feature": [list(feature)], "cut": [list(cuts)], "level": [list(levels)],
                             "below": [list(below)], "beyond": [list(beyond)]})
    return run


def _descend(whole: Metric, name: str):
    """Rows with the leaf of the tree they come to."""
    def run(rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        node = np.zeros(len(rows), np.int64)
        if len(rows):
            num, cat, _ = whole.under(0, Vectors(rows))
            feature, cut, level, below, beyond = (np.asarray(tree[c].iloc[0]) for c in ("feature", "cut", "level", "below", "beyond"))
            node = node if len(feature) else node - 1
            while (todo := np.flatnonzero(node >= 0)).size:
                at, left = node[todo], np.empty(len(todo), bool)
                for f in np.unique(feature[at]):
                    mine = feature[at] == f
                    left[mine] = num[todo[mine], f] <= cut[at[mine]] if f < num.shape[1] else cat[todo[mine], f - num.shape[1]] <= level[at[mine]]
                node[todo] = np.where(left, below[at], beyond[at])
        return rows.drop(columns="_b").assign(**{name: -1 - node})
    return run


def _open_boxes(metric: Metric, key: str):
    """Boxes whose rows may be within the bound of a query under some view: the lower bounds, and the least lead on the bound."""
    def run(q: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        columns: dict[str, list] = {c: [] for c in ("q", key, "lead", "low")}
        if len(q) and len(cells):
            queries, every = Vectors(q), np.arange(len(cells))[None, :]
            bounds, home = np.stack(q["bound"].to_numpy()).astype(float), q["home"].to_numpy()  # no home among parents
            spans = {c: np.array([[list(frame) for frame in x] for x in cells[c]], dtype=float) for c in ("lo", "hi", "least", "most")}
            codes = [np.stack(cells[c].to_numpy()).astype(np.int64).reshape(len(cells), -1) for c in ("first", "last")]
            step = max(1, KERNEL_VALUES // (len(cells) * (len(metric.views) + 4)))
            for start in range(0, len(q), step):
                some, bound = queries.take(slice(start, start + step)), bounds[start:start + step]
                low = np.empty((len(metric.views), len(some), len(cells)))
                for v, view in enumerate(metric.views):
                    frame, num, cat, mine = v if metric.name == "cosine" else 0, list(view.num), list(view.cat), metric.under(v, some)
                    boxes = [[spans[c][:, frame, at].T for c, at in zip(pair, (pick, pick))] for pair, pick in ((("lo", "hi"), num), (("least", "most"), cat))]
                    low[v] = _low(metric, mine, np.arange(len(some))[:, None], [*boxes, [x[:, cat].T for x in codes]], every)
                    low[v][np.isnan(mine[0]).any(axis=1) | np.isnan(mine[2]).any(axis=1)] = np.inf  # meets no row
                may = (low <= _reach(bound).T[:, :, None]) & (low < np.inf)
                with np.errstate(invalid="ignore"):
                    lead = np.where(may, np.nan_to_num(low - bound.T[:, :, None], nan=-np.inf, neginf=-np.inf), np.inf).min(axis=0)
                iq, ia = np.nonzero(may.any(axis=0) & (home[start:start + step, None] != cells[key].to_numpy()[None, :]))
                columns["q"].append(q["q"].to_numpy()[start + iq])
                columns[key].append(cells[key].to_numpy()[ia])
                columns["lead"].append(lead[iq, ia])
                columns["low"].extend(low[:, iq, ia].T.tolist())
        return pd.DataFrame({c: (pd.Series(x, dtype=object) if c == "low" else np.concatenate(x) if x else []) for c, x in columns.items()})
    return run


class _Cells:
    """k-d cells over ``rows(part, id, ids, num, cat, w)`` with the boxes of their rows; every table of it is written."""

    def __init__(self, rows: DataFrame, sizes: DataFrame, metric: Metric, whole: Metric):
        self.metric, self.whole, self.trees = metric, whole, []
        fan = F.when(F.col("cells") <= FAN, F.col("cells")).otherwise(F.ceil(F.sqrt("cells")))
        self.deep = (sizes.agg(F.max("cells")).first()[0] or 1) > FAN
        rows = self._cut(rows, sizes.select("part", "n", "first_id", fan.alias("fan")), ["part"], "parent")
        if self.deep:
            own = sizes.select("part", F.when(F.col("cells") > FAN, F.col("n") / F.col("cells")).otherwise(F.col("n")).alias("aim"))
            n, draw = F.count(F.lit(1)), F.struct(uniform("pivot", "id"), "id")
            rows = materialize(rows, "parents")
            inner = rows.groupBy("part", "parent").agg(n.alias("n"), F.min_by("id", draw).alias("first_id")).join(own, "part")
            rows = self._cut(rows, inner.select("part", "parent", "n", "first_id", F.ceil(F.col("n") / F.col("aim")).alias("fan")), ["part", "parent"], "leaf")
        self.rows = materialize(self._numbered(rows, "cell"), "cells")
        self.cells = materialize(self._boxes(["part", "parent", "cell"]), "cell-index")
        self.parents = materialize(self._boxes(["part", "parent"]), "parent-index") if self.deep else None

    def _numbered(self, rows: DataFrame, name: str) -> DataFrame:
        """Number of the cell from the leaves of both trees."""
        cell = F.shiftleft("parent", 32) + F.col("leaf") if self.deep else F.col("parent")
        return rows.withColumn(name, cell).drop("leaf")

    def _cut(self, rows: DataFrame, sizes: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Grow a tree for every key and take the rows through it."""
        sample = attach_groups(rows, sizes, keys, "inner").filter(
            (uniform("pivot", "id") * F.col("n") < F.col("fan") * SAMPLE) & (F.col("fan") > 1) | (F.col("id") == F.col("first_id")))
        types = dict(rows.dtypes)
        schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", feature array<int>, cut array<double>, level array<bigint>, below array<int>, beyond array<int>"
        self.trees.append((materialize(sample.select(*keys, "fan", "num", "cat", "w").groupBy(*keys).applyInPandas(_grow(self.whole, keys), schema), "trees"), keys, name))
        return self._placed(rows, "id", *self.trees[-1])

    def _placed(self, rows: DataFrame, row_id: str, trees: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Rows with their leaf, a block of rows of a key at a time."""
        blocks = materialize(rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / OPEN_ROWS).cast("int").alias("_n")), "blocks")
        cut = attach_groups(rows, blocks, keys, "inner").withColumn("_b", F.pmod(F.xxhash64(row_id), F.col("_n")).cast("int")).select(*rows.columns, "_b")
        spread = trees.join(blocks, keys).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {name} bigint"
        return cut.groupBy(*keys, "_b").cogroup(spread.groupBy(*keys, "_b")).applyInPandas(_descend(self.whole, name), schema)

    def _boxes(self, keys: list[str]) -> DataFrame:
        """Least and greatest numbers, weights and codes per key; under cosine of vectors of length 1 under every view."""
        whole = self.whole.views[0]
        num, w = [F.col("num")[i] for i in whole.num], [F.col("w")[j] for j in whole.cat]

        def length(view: View):
            return F.sqrt(sum((x * x for x in [*[num[i] for i in view.num], *[w[j] for j in view.cat]]), F.lit(0.0))) + 1e-12

        lengths = [length(v) for v in self.metric.views] if self.metric.name == "cosine" else [F.lit(1.0)]

        def span(agg, values: list):
            return F.array(*[F.array(*[agg(F.when(~F.isnan(x / d), x / d)) for x in values]).cast("array<double>") for d in lengths])

        codes = [F.col("cat")[j] for j in whole.cat]
        return self.rows.groupBy(*keys).agg(span(F.min, num).alias("lo"), span(F.max, num).alias("hi"), span(F.min, w).alias("least"), span(F.max, w).alias("most"),
                                            *[F.array(*[agg(x) for x in codes]).cast("array<bigint>").alias(c) for c, agg in (("first", F.min), ("last", F.max))])

    def homes(self, queries: DataFrame) -> DataFrame:
        """Queries with their home cell."""
        for tree in self.trees:
            queries = self._placed(queries, "q", *tree)
        return self._numbered(queries, "home").drop("parent")

    def open_cells(self, queries: DataFrame) -> DataFrame:
        """``q, cell, low, place`` of ``queries(.., home, bound)``: cells that cannot be ruled out, by lower bound."""
        asked, keys = queries.select("part", "q", "num", "cat", "w", "bound", "home"), ["part"]
        if self.deep:
            parents = _meet(asked.withColumn("home", F.lit(None).cast("double")), self.parents, ["part"], "q", "parent", OPEN_ROWS).applyInPandas(
                _open_boxes(self.metric, "parent"), "q bigint, parent bigint, lead double, low array<double>")
            asked, keys = materialize(parents.select("q", "parent").join(asked, "q"), "open-parents"), ["part", "parent"]
        found = _meet(asked, self.cells, keys, "q", "cell", OPEN_ROWS).applyInPandas(
            _open_boxes(self.metric, "cell"), "q bigint, cell bigint, lead double, low array<double>")
        return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("lead", F.array_min("low"), "cell")))


def knn(a: DataFrame, c: DataFrame, k: int, metric: str = "l1", views: list[View] | None = None,
        block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, visits: Visits | None = None) -> DataFrame:
    """k nearest population rows per distinct query vector.

    Inputs hold (id, num, cat, w) and optionally ``part``: a query only meets rows of its own
    part. ``views`` searches every feature subspace at once. ``metric`` is l1, l2
    or cosine (L2 on unit rows). Output: part (with views: the view's name), qid (smallest id among equal
    queries), mult (how many queries share the vector), rank, id, dist.
    """
    if views or "part" not in a.columns:
        a, c = a.withColumn("part", F.lit("*")), c.withColumn("part", F.lit("*"))
    vec = ["part", "num", "cat", "w"]
    copies, own = Window.partitionBy(*vec).orderBy("id"), F.coalesce("id", F.lit(NO_ID))
    first = a.select(own.alias("id"), *vec).withColumn("__rn", F.row_number().over(copies)).filter(F.col("__rn") <= k)
    rows = materialize(first.groupBy(*vec).agg(F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("ids")).select("id", "ids", *vec))
    width = rows.select(F.size("num").alias("n"), F.size("cat").alias("m")).first()
    shape = (width["n"], width["m"]) if width else (0, 0)
    block_rows = min(block_rows, max(BLOCK_VALUES // max(sum(shape), 1), 1024))
    everything = View("*", tuple(range(shape[0])), tuple(range(shape[1])))
    ask, whole = Metric(metric, views or [everything], *shape), Metric(metric, [everything], *shape)
    sizes = materialize(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct(uniform("pivot", "id"), "id")).alias("first_id")).withColumn(
        "cells", F.ceil(F.col("n") / min(cell_rows, max(block_rows * 3 // 4, 1)))))
    no_bound = F.array(*[F.lit(float("inf")) for _ in ask.views])
    queries = materialize(attach_groups(c.groupBy(*vec).agg(F.min("id").alias("qid"), F.count(F.lit(1)).alias("mult")), sizes.select("part"), ["part"], "inner").withColumns(
        {"bound": no_bound, "q": F.monotonically_increasing_id()}))  # ids may repeat
    pairs = queries.count() * math.ceil(rows.count() / block_rows)
    ask_rows = max(min(pairs // ASK_BLOCKS, ASK_ROWS[1], ASK_HITS // (k * len(ask.views))), ASK_ROWS[0])

    def visit(placed: DataFrame, asked: DataFrame, found: DataFrame | None = None, again: bool = True) -> DataFrame:
        """Best hits so far after queries (with ``cell`` and ``bound``) met the rows of their cells, one list a query where it goes on."""
        if visits is not None:
            visits.steps.append(placed.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n")).join(
                asked.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("nq")), ["part", "cell"]))
        left, right, on = asked.select("part", "cell", "q", "qid", "mult", "num", "cat", "w", "bound"), placed.select("part", "cell", "id", "ids", "num", "cat", "w"), ["part", "cell"]
        both = _blocks(left, right, on, block_rows, ask_rows)
        met = both.agg(F.max("_rn").alias("most"), F.sum("meetings").alias("n"), F.sum(F.col("_ln") * F.col("_rn")).alias("pairs")).first()
        chunks = min(math.ceil(VIEW_BLOCKS / (met["pairs"] or 1)), len(ask.views)) if sum(shape) <= NARROW else 1
        left = left.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in range(chunks)])))
        right = right.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in range(chunks)])))
        hits = _meet(left, right, [*on, "_v"], "qid", "id", block_rows, ask_rows,
                     both.withColumn("_v", F.explode(F.array(*[F.lit(v) for v in range(chunks)]))), min(2 * chunks * (met["pairs"] or 1), MOST_TASKS)).applyInArrow(_best_rows(ask, k, chunks), FOUND)
        if found is None and (met["most"] or 0) <= 1 and (chunks == 1 or not again):  # a query met one block under each view
            return hits
        lists = (met["n"] or 0) + (0 if found is None else found.count())
        block = F.pmod(F.xxhash64("q"), F.lit(max(math.ceil(lists * k * len(ask.views) / ASK_HITS), 1)))
        every = hits if found is None else found.unionByName(hits)
        return every.withColumn("_b", block).groupBy("_b").applyInArrow(_merge(k, len(ask.views)), FOUND)

    if (sizes.agg(F.max("cells")).first()[0] or 1) == 1:
        found = visit(rows.withColumn("cell", F.lit(0)), queries.withColumn("cell", F.lit(0)), again=False)
    else:
        index = _Cells(rows, sizes, ask, whole) if sum(shape) <= NARROW else _Index(rows, sizes, ask, whole, block_rows)
        found = _search(index, queries, visit)
    found = found.select("part", "qid", "mult", F.inline(F.arrays_zip("view", "rank", "id", "dist"))).select(
        F.element_at(F.array(*[F.lit(v.name) for v in views]), F.col("view") + 1).alias("part") if views else "part",
        "qid", "mult", F.nullif("id", F.lit(NO_ID)).alias("id"), "dist", "rank")
    return found


def _search(index: _Cells | _Index, queries: DataFrame, visit) -> DataFrame:
    """Home cells, then open cells by lower bound in growing steps; the best so far is written after each step."""
    queries = materialize(index.homes(queries), "homes")
    found = materialize(visit(index.rows, queries.withColumn("cell", F.col("home"))), "best")

    def bounded(asked: DataFrame, found: DataFrame) -> DataFrame:
        so_far = found.select("q", F.col("bound").alias("_bound"))
        return asked.join(so_far, "q", "left").withColumn("bound", F.coalesce("_bound", "bound")).drop("_bound")

    open_ = materialize(index.open_cells(bounded(queries, found)), "open-cells")
    last, done, step = open_.agg(F.max("place")).first()[0] or 0, 0, FIRST_CELLS
    while done < last:
        todo = bounded(open_.filter((F.col("place") > done) & (F.col("place") <= done + step)).join(queries, "q"), found)
        todo = materialize(todo.filter(F.exists(F.arrays_zip("low", "bound"), lambda x: x["low"] <= x["bound"] + SLACK)), "todo")
        found = materialize(visit(index.rows, todo, found), "best")
        done, step = done + step, step * STEP
    return found


def per_query(c: DataFrame, found: DataFrame, metric: str = "l1") -> DataFrame:
    """Repeat the result of a shared query vector for each of its query rows (single view)."""
    q = c if "part" in c.columns else c.withColumn("part", F.lit("*"))
    vec = ["part", "num", "cat", "w"]
    shared = q.groupBy(*vec).agg(F.min("id").alias("qid"))
    return q.select(F.col("id").alias("query_id"), *vec).join(shared, vec).select("query_id", "part", "qid").join(
        found.drop("mult"), ["part", "qid"]).select("query_id", "rank", "id", "dist")
