"""Overlaps of boxes that meet in a tile of the picture: bounds of whole leaves first, then the boxes that these leave."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Boxes of a leaf: neighbours in place and size, for which one bound holds.
LEAF = 32
#: Overlaps that are computed at once, and leaves that are compared at once.
AT_ONCE, LEAVES_AT_ONCE = 1 << 15, 1 << 18
#: Pairs of ids in a batch that leaves a task, besides those of one more pair of rows.
PAIRS_A_BATCH = 1 << 17
_NONE = np.iinfo(np.int64).max


def _neighbours(*measures: np.ndarray) -> np.ndarray:
    """An order of boxes in which each run of ``LEAF`` holds boxes alike in all measures."""
    parts, out = [np.arange(len(measures[0]))], []
    while parts:
        part = parts.pop()
        if len(part) <= LEAF:
            out.append(part)
            continue
        own = max((m[part] for m in measures), key=np.ptp)
        half = -(-len(part) // (2 * LEAF)) * LEAF
        order = np.argpartition(own, half)
        parts += [part[order[half:]], part[order[:half]]]
    return np.concatenate(out)


def _share(a: tuple, b: tuple) -> np.ndarray:
    """Intersection over union of boxes given as (x, y, right, low, area); 0 if the union is not positive."""
    (ax, ay, ar, al, aa), (bx, by, br, bl, ba) = a, b
    common, high = np.minimum(ar, br), np.minimum(al, bl)
    common -= np.maximum(ax, bx)
    high -= np.maximum(ay, by)
    common = np.maximum(common, 0, out=common)
    common *= np.maximum(high, 0, out=high)
    union = np.add(aa, ba, out=high)
    union -= common
    return common / union if not union.size or union.min() > 0 else np.divide(common, union, out=np.zeros_like(common), where=union > 0)


def _bound(a: tuple, b: tuple) -> np.ndarray:
    """No two boxes within extents (x, y, right, low, widest, highest, least area) overlap by more."""
    (ax, ay, ar, al, aw, ah, aa), (bx, by, br, bl, bw, bh, ba) = a, b
    common, high = np.minimum(ar, br), np.minimum(al, bl)
    common -= np.maximum(ax, bx)
    high -= np.maximum(ay, by)
    common = np.clip(common, 0, np.minimum(aw, bw), out=common)
    common *= np.clip(high, 0, np.minimum(ah, bh), out=high)
    union = np.add(aa, ba, out=high)
    union -= common
    return common / union if not union.size or union.min() > 0 else np.divide(common, union, out=np.full_like(common, np.inf), where=union > 0)


class Boxes:
    """Boxes (of positive size) dealt to leaves, with the extents of each leaf; the last leaf is filled up with boxes that overlap nothing."""

    def __init__(self, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, ids: np.ndarray):
        self.order, self.n = _neighbours(x, y, width, height), len(x)
        x, y, width, height, ids = (v[self.order] for v in (x, y, width, height, ids))
        right, low, area, cuts = x + width, y + height, width * height, np.arange(0, self.n, LEAF)
        least, most = (lambda v: np.minimum.reduceat(v, cuts)), (lambda v: np.maximum.reduceat(v, cuts))
        # What a pair has in common is computed from corners, so the widest is too: then no rounding lifts a pair above its bound.
        self.extents = least(x), least(y), most(right), most(low), most(right - x), most(low - y), least(area)
        self.largest, self.smallest, self.leaves = most(area), least(area), len(cuts)
        mean = [np.add.reduceat(v, cuts) / np.diff([*cuts, self.n]) for v in (x, y, right, low)]
        self.middle = *mean, (mean[2] - mean[0]) * (mean[3] - mean[1])
        fill = lambda v, by: np.concatenate([v, np.full(-self.n % LEAF, by, v.dtype)]).reshape(-1, LEAF)
        self.boxes = fill(x, np.inf), fill(y, np.inf), fill(right, -np.inf), fill(low, -np.inf), fill(area, 1.0)
        self.spans = *self.boxes[:4], fill(right - x, 0.0), fill(low - y, 0.0), self.boxes[4]
        self.ids = fill(ids, _NONE)

    def each(self, v: np.ndarray) -> np.ndarray:
        """What belongs to the boxes, without those that fill up."""
        return v.reshape(-1)[: self.n]

    def needs(self, least: float) -> np.ndarray:
        """A bound that each box goes on from."""
        need = np.full((self.leaves, LEAF), np.inf)
        self.each(need)[:] = least
        return need


def _meeting(a: Boxes, b: Boxes, need: np.ndarray, may: Callable[[np.ndarray], np.ndarray], first: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of boxes of ``a``, leaves of ``b`` and the overlaps of the box with the leaf's boxes, without those that ``need`` rules out.

    Leaves are compared with leaves by their bounds, then boxes with the leaves that
    are left.  The most alike leaves come first, four times as many in each round, so
    a reader who raises ``need`` by what was found meets few others.
    """
    for at in range(0, a.leaves, max(1, LEAVES_AT_ONCE // b.leaves)):
        own = np.arange(at, min(at + max(1, LEAVES_AT_ONCE // b.leaves), a.leaves))
        of = lambda measures: tuple(m[own, None] for m in measures)  # noqa: B023, E731
        bound, alike = _bound(of(a.extents), b.extents), _share(of(a.middle), b.middle) if first < b.leaves else None
        many = first
        bound[~may(own)] = -1
        while (open_ := bound >= need[own].min(axis=1)[:, None]).any():
            if many < b.leaves:
                chosen = np.zeros_like(open_)
                np.put_along_axis(chosen, np.argpartition(np.where(open_, alike, -1), -many, axis=1)[:, -many:], True, axis=1)
                open_ &= chosen
            i, leaf = np.nonzero(open_)
            bound[i, leaf] = -1
            i += at
            for k in range(0, len(i), AT_ONCE // LEAF):
                some, their = i[k : k + AT_ONCE // LEAF], leaf[k : k + AT_ONCE // LEAF]
                p, q = np.nonzero(_bound(tuple(v[some] for v in a.spans), tuple(v[their, None] for v in b.extents)) >= need[some])
                rows, their = some[p] * LEAF + q, their[p]
                for m in range(0, len(rows), AT_ONCE // LEAF):
                    r, t = rows[m : m + AT_ONCE // LEAF], their[m : m + AT_ONCE // LEAF]
                    yield r, t, _share(tuple(v.reshape(-1)[r, None] for v in a.boxes), tuple(v[t] for v in b.boxes))
            many *= 4


def _anything(a: Boxes, b: Boxes) -> Callable[[np.ndarray], np.ndarray]:
    return lambda own: np.ones((len(own), b.leaves), bool)


def best(a: Boxes, b: Boxes, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """For each box of ``a`` its highest overlap with one of ``b``, if ``floor`` (above 0) or more, and the lowest id that has it; else 0."""
    need, share, other = a.needs(floor), np.zeros(a.leaves * LEAF), np.full(a.leaves * LEAF, _NONE)
    for rows, leaf, made in _meeting(a, b, need, _anything(a, b)):
        top = made.max(axis=1)
        who = np.where(made == top[:, None], b.ids[leaf], _NONE).min(axis=1)
        order = np.lexsort((who, -top, rows))
        order = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
        rows, top, who = rows[order], top[order], who[order]
        new = (top >= floor) & ((top > share[rows]) | ((top == share[rows]) & (who < other[rows])))
        rows = rows[new]
        share[rows], other[rows] = top[new], who[new]
        need.reshape(-1)[rows] = top[new]
    return a.each(share), a.each(other)


def larger(a: Boxes, b: Boxes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each box of ``a``: whether a larger one of ``b`` overlaps it by more than ``threshold``; without one, the lowest id of those as large."""
    need, found, least = a.needs(np.nextafter(threshold, np.inf)), np.zeros(a.leaves * LEAF, bool), np.full(a.leaves * LEAF, _NONE)
    for rows, leaf, made in _meeting(a, b, need, lambda own: b.largest >= a.smallest[own, None]):
        over, area, mine = made > threshold, b.boxes[4][leaf], a.boxes[4].reshape(-1)[rows, None]
        dead = rows[(over & (area > mine)).any(axis=1)]
        found[dead] = True
        need.reshape(-1)[dead] = np.inf
        same, at = np.nonzero(over & (area == mine))
        np.minimum.at(least, rows[same], b.ids[leaf[same], at])
    return a.each(found), a.each(least)


def pairs(boxes: Boxes, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of two boxes and their overlap above ``threshold``: those marked ``own`` (in the order of leaves) with themselves and all that come later."""
    need = boxes.needs(np.nextafter(threshold, np.inf))
    boxes.each(need)[~own] = np.inf
    for rows, leaf, made in _meeting(boxes, boxes, need, lambda mine: np.arange(boxes.leaves) >= mine[:, None], boxes.leaves):
        p, q = np.nonzero(made > threshold)
        i, j = rows[p], leaf[p] * LEAF + q
        later = np.flatnonzero(j >= i)
        yield i[later], j[later], made[p[later], q[later]]


def above(a: Boxes, b: Boxes, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlaps of ``least`` (above 0) or more between two sets of boxes, with the ids of both."""
    for rows, leaf, made in _meeting(a, b, a.needs(least), _anything(a, b), b.leaves):
        p, q = np.nonzero(made >= least)
        yield made[p, q], a.ids.reshape(-1)[rows[p]], b.ids[leaf[p], q]


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> tuple[pa.Table, list[np.ndarray]]:
    rows = pa.Table.from_batches(batches)
    return rows, [rows.column(c).to_numpy() for c in names]


def _boxes(x, y, width, height, ids, some) -> Boxes:
    return Boxes(*(v[some].astype(float) for v in (x, y, width, height)), ids[some])


def best_of_tile(batches: Iterator[pa.RecordBatch], keys: list[str], floor: float) -> Iterator[pa.RecordBatch]:
    """For the boxes of both sides that meet in a tile their best overlaps there."""
    rows, (*box, ids, own) = _columns(batches, "x", "y", "width", "height", "id", "_own")
    if own.any() and not own.all():
        a, b = _boxes(*box, ids, own), _boxes(*box, ids, ~own)
        for side, one, two in ((True, a, b), (False, b, a)):
            share, other = best(one, two, floor)
            some = np.flatnonzero(share > 0)
            if len(some):
                fixed = [pa.repeat(rows.column(k)[0], len(some)) for k in keys]
                yield pa.RecordBatch.from_arrays([*fixed, pa.repeat(side, len(some)), pa.array(one.each(one.ids)[some]), pa.array(share[some]), pa.array(other[some])], names=[*keys, "first", "id", "iou", "other"])


def larger_of_tile(batches: Iterator[pa.RecordBatch], keys: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """Boxes of a tile (by id) that a larger one, or one as large of a lower id, overlaps, with the lowest id of the latter."""
    rows, (*box, ids, own) = _columns(batches, "x", "y", "width", "height", "id", "_own")
    if own.any():
        b = _boxes(*box, ids, slice(None))
        a = b if own.all() else _boxes(*box, ids, own)
        found, least = larger(a, b, threshold)
        some = np.flatnonzero(found | (least < _NONE))
        if len(some):
            fixed = [pa.repeat(rows.column(k)[0], len(some)) for k in keys]
            yield pa.RecordBatch.from_arrays([*fixed, pa.array(a.each(a.ids)[some]), pa.array(found[some]), pa.array(least[some], mask=least[some] == _NONE)], names=[*keys, "id", "larger", "least"])


def _round(v: np.ndarray, digits: int) -> np.ndarray:
    """Half up by decimal digits, as Spark and SQL round; shares that lie near a half go through decimals."""
    from decimal import ROUND_HALF_UP, Decimal

    scaled = v * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[k] = float(Decimal(repr(float(v[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _spans(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (so ``many`` each) one after another."""
    ends = np.cumsum(many)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + many, many)


def pairs_of_tile(batches: Iterator[pa.RecordBatch], keys: list[str], threshold: float, tile: float | None, digits: int | None, areas: bool) -> Iterator[pa.RecordBatch]:
    """All pairs of ids (lower first) whose boxes overlap and have the corner of what they share in the tile, in batches."""
    rows = pa.Table.from_batches(batches)
    rows = rows.take(pa.array(np.argsort(rows.column("id").to_numpy())))  # the order of leaves must be that of all groups of the tile
    _, (*box, ids, own, cx, cy) = _columns(iter(rows.to_batches()), "x", "y", "width", "height", "id", "_own", "_cx", "_cy")
    if not own.any():
        return
    boxes = _boxes(*box, ids, slice(None))
    copies = rows.column("ids").combine_chunks()
    copies = copies.chunk(0) if isinstance(copies, pa.ChunkedArray) else copies
    starts, ids = copies.offsets.to_numpy(), copies.values.to_numpy()
    x, y, area = (boxes.each(boxes.boxes[k]) for k in (0, 1, 4))
    first, many = starts[:-1][boxes.order], np.diff(starts)[boxes.order]
    names = [*keys, "det_a", "det_b", *(["area_a", "area_b"] if areas else []), "iou"]

    def batch(i: np.ndarray, j: np.ndarray, share: np.ndarray) -> pa.RecordBatch:
        """Pairs of ids of the rows ``i`` and ``j``."""
        if (many[i] == 1).all() and (many[j] == 1).all():
            each, p, q = slice(None), ids[first[i]], ids[first[j]]
        else:
            lead = np.repeat(np.arange(len(i)), many[i])  # a row for each id of the first box
            follow = many[j][lead]
            q = ids[_spans(first[j][lead], follow)]
            p, each = np.repeat(ids[_spans(first[i], many[i])], follow), np.repeat(lead, follow)
        one = i == j
        if one.any():
            kept = np.flatnonzero(np.where(one[each], p < q, p != q))
            p, q, each = p[kept], q[kept], kept if isinstance(each, slice) else each[kept]
        low = p < q
        sizes = [np.where(low, area[i][each], area[j][each]), np.where(low, area[j][each], area[i][each])] if areas else []
        fixed = [pa.repeat(rows.column(k)[0], len(p)) for k in keys]
        return pa.RecordBatch.from_arrays([*fixed, *map(pa.array, (np.minimum(p, q), np.maximum(p, q), *sizes, share[each]))], names=names)

    for i, j, share in pairs(boxes, own[boxes.order], threshold):
        if tile:
            here = np.flatnonzero((np.floor(np.maximum(x[i], x[j]) / tile) == cx[0]) & (np.floor(np.maximum(y[i], y[j]) / tile) == cy[0]))
            i, j, share = i[here], j[here], share[here]
        share = share if digits is None else _round(share, digits)
        if len(i):
            cuts = np.flatnonzero(np.diff(np.cumsum(many[i].astype(np.int64) * many[j]) // PAIRS_A_BATCH)) + 1
            for some in np.split(np.arange(len(i)), cuts):
                yield batch(i[some], j[some], share[some])
