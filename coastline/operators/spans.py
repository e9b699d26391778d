"""Cells that segments meet, as spans of neighbouring cells in one column of a grid: NumPy over many segments, curves and sizes at once.

Within a column a segment runs between its heights at the column's two sides, and a height at
a side is that of both columns beside it: in units of cells, heights at the sides of
neighbouring columns are a segment's slope apart. The rows between follow from them. Where a
height lies on the edge of two rows, or as near to it as rounding may go, the test of segment
against closed cell (``boxcount.MEETS``) decides about the rows around it, in the same order
of operations, so that counts are those of testing each cell.

What is counted is a unit: a body, such as a curve at one angle, in a grid. Bodies are ranges of
the segments' rows. Heights are found for many units at a time, and spans are sorted as single
numbers of unit, column, first row and length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs of a segment and a grid, and heights, that are held at a time: as many as stay in a core's cache.
PAIRS, BATCH = 1 << 12, 1 << 15
#: Heights as near to an edge as this, in cells, are tested; where rounding may go further, those of a segment in each column by itself.
NEAR = 1e-6

Arrays = tuple[np.ndarray, ...]


def _meets(x1, y1, x2, y2, bx0, bx1, by0, by1) -> np.ndarray:
    """Segment (x1, y1)-(x2, y2) meets the closed box."""
    dx, dy = x2 - x1, y2 - y1
    apart = ((x1 < bx0) & (x2 < bx0)) | ((x1 > bx1) & (x2 > bx1)) | ((y1 < by0) & (y2 < by0)) | ((y1 > by1) & (y2 > by1))
    found = ((x1 >= bx0) & (x1 <= bx1) & (y1 >= by0) & (y1 <= by1)) | ((x2 >= bx0) & (x2 <= bx1) & (y2 >= by0) & (y2 <= by1))
    for a, b, lo, hi, da, db, cuts in ((x1, y1, by0, by1, dx, dy, (bx0, bx1)), (y1, x1, bx0, bx1, dy, dx, (by0, by1))):
        long = np.abs(da) > 1e-10
        for at in cuts:
            t = (at - a) / np.where(long, da, 1.0)
            h = b + t * db
            found |= long & (t >= 0) & (t <= 1) & (h >= lo) & (h <= hi)
    return found & ~apart


def _tested(seg: Arrays, box: Arrays, i: np.ndarray, low: np.ndarray, high: np.ndarray) -> Arrays:
    """First and last row that each segment meets in column i, if they are next to rows low and high; none where the first is after the last."""
    d, x0, y0, n = box
    # rows around both ends; those between are crossed from edge to edge
    rows = np.stack([low - 1, low, low + 1, high - 1, high, high + 1])
    met = (rows >= 0) & (rows < n) & _meets(*seg, x0 + i * d, x0 + (i + 1) * d, y0 + rows * d, y0 + (rows + 1) * d)
    first, last = np.where(met, rows, np.inf).min(0), np.where(met, rows, -np.inf).max(0)
    return np.maximum(np.minimum(first, low + 2), 0), np.minimum(np.maximum(last, high - 2), n - 1)


def _each(seg: Arrays, box: Arrays, i: np.ndarray, slope: np.ndarray, slack: np.ndarray) -> Arrays:
    """First and last row of segments in column i, from heights reckoned for that column alone."""
    x1, y1, x2, y2 = seg
    delta, xmin, ymin, ny = box
    steep = np.isnan(slope)
    at = np.where(steep, 0.0, slope)
    ya = np.where(steep, y1, y1 + (np.maximum(np.minimum(x1, x2), xmin + i * delta) - x1) * at)
    yb = np.where(steep, y2, y1 + (np.minimum(np.maximum(x1, x2), xmin + (i + 1) * delta) - x1) * at)
    u, v = (np.minimum(ya, yb) - ymin) / delta, (np.maximum(ya, yb) - ymin) / delta
    r0, r1 = np.floor(u), np.floor(v)
    first, last = np.maximum(r0, 0), np.minimum(r1, ny - 1)
    close = np.flatnonzero((np.abs(u - np.rint(u)) <= slack) | (np.abs(v - np.rint(v)) <= slack))
    if len(close):
        first[close], last[close] = _tested(tuple(c[close] for c in seg), tuple(c[close] for c in box), i[close], r0[close], r1[close])
    return first, last


def turned(segs: Arrays, centre: Arrays, angles: Sequence[float]) -> Arrays:
    """Segments turned by each angle in degrees about their centres: all of them by the first, then all by the next."""
    x1, y1, x2, y2 = segs
    cx, cy = centre
    a = np.array([math.radians(a) for a in angles])
    c, s = np.array([math.cos(v) for v in a])[:, None], np.array([math.sin(v) for v in a])[:, None]
    ends = [((x - cx) * c - (y - cy) * s + cx, (x - cx) * s + (y - cy) * c + cy) for x, y in ((x1, y1), (x2, y2))]
    return tuple(v.ravel() for end in ends for v in end)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)


def _sorted(segs: Arrays, start: np.ndarray, length: np.ndarray, grids: Arrays, body: np.ndarray, grid: np.ndarray) -> Iterator[tuple]:
    """Spans of some units at a time, sorted: first and last unit, and of the spans codes of their first and last cells, how codes are split, and the first column."""
    x1, y1, x2, y2 = segs
    delta, xmin, xmax, ymin, ymax = grids
    nx, ny = np.ceil((xmax - xmin) / delta), np.ceil((ymax - ymin) / delta)
    usable = np.isfinite(nx) & np.isfinite(ny) & (delta > 0) & (nx > 0) & (ny > 0)
    dx = x2 - x1
    turn = dx < 0
    good = np.isfinite(x1) & np.isfinite(y1) & np.isfinite(x2) & np.isfinite(y2)
    slope = np.where(np.abs(dx) > 1e-10, (y2 - y1) / np.where(dx == 0, 1.0, dx), np.nan)
    tilt = np.nan_to_num(np.abs(slope))
    reach = np.maximum(np.abs(y1), np.abs(y2)) + tilt * np.maximum(np.abs(x1), np.abs(x2))
    left, right = np.where(good, np.where(turn, x2, x1), np.inf), np.where(good, np.where(turn, x1, x2), -np.inf)
    lines = np.where(turn, y2, y1), np.where(turn, y1, y2), slope, tilt, reach
    many = np.where(usable[grid], length[body], 0)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(many):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
        n = many[lo:hi]
        g = grid[lo:hi]
        s = ranges(start[body[lo:hi]], n)
        box = [np.repeat(c[g], n) for c in (delta, xmin, ymin, ny - 1)]
        a, b, d, x0 = left.take(s), right.take(s), box[0], box[1]
        i0 = np.maximum(0.0, np.floor((a - x0) / d) - 1)
        i1 = np.minimum(np.repeat(nx[g] - 1, n), np.floor((b - x0) / d) + 1)
        for _ in range(2):  # columns that end before the segment or begin after it
            i0 += x0 + (i0 + 1) * d < a
            i1 -= x0 + i1 * d > b
        upto = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([[0.0], np.cumsum(np.maximum(0.0, i1 - i0 + 2))])[upto]
        k = 0
        while k < hi - lo:
            m = max(k + 1, int(np.searchsorted(sums, sums[k] + BATCH, "right")) - 1)
            if (m - k) * nx[g[k:m]].max() >= 2.0**50:
                m = k + 1
            here = slice(upto[k], upto[m])
            # one unit with more spans than a batch goes by ranges of columns
            parts = int(np.ceil((sums[m] - sums[k]) / BATCH)) or 1
            cuts = [-np.inf, np.inf] if parts == 1 else [-np.inf, *np.unique(np.linspace(i0[here].min(), i1[here].max() + 1, parts + 1)[1:-1].round()), np.inf]
            for low, high in zip(cuts, cuts[1:], strict=False):
                first, last = (i0[here], i1[here]) if parts == 1 else (np.maximum(i0[here], low), np.minimum(i1[here], high - 1))
                found = _spans(segs, s[here], (a[here], b[here]), lines, [c[here] for c in box], np.repeat(np.arange(m - k, dtype=np.float64), n[k:m]), first, last)
                if found is not None:
                    yield lo + k, lo + m, *found
            k = m
        lo = hi


def _spans(segs: Arrays, s: np.ndarray, sides: Arrays, lines: Arrays, box: Arrays, unit: np.ndarray, i0: np.ndarray, i1: np.ndarray) -> tuple | None:
    """Spans of pairs of a segment and a grid in their columns i0 to i1."""
    live = np.flatnonzero(i0 <= i1)
    if not len(live):
        return None
    if len(live) < len(s):
        s, unit, i0, i1 = s[live], unit[live], i0[live], i1[live]
        sides, box = [c[live] for c in sides], [c[live] for c in box]
    (left, right), (d, x0, y0, top) = sides, box
    yl, yr, slope, tilt, reach = (c.take(s) for c in lines)
    base = i0.min()
    columns = i1.max() - base + 1
    wide = (i1 - i0 + 2).astype(np.int64)
    slack = 1e-9 + 1e-14 * (reach + np.abs(y0) + tilt * np.abs(x0)) / d
    odd = np.flatnonzero(~(slack + 2e-15 * wide.sum() * tilt + slope * 0 <= NEAR))  # steep or upright
    place = unit * columns + (i0 - base)
    bits = min(64, (int(top.max()) + 2).bit_length())
    more = None
    if len(odd):
        p = np.repeat(odd, wide[odd] - 1)
        i = ranges(i0[odd].astype(np.int64), wide[odd] - 1).astype(np.float64)
        more = _each(tuple(c[s[p]] for c in segs), (d[p], x0[p], y0[p], top[p] + 1), i, slope[p], slack[p])
        more = place[p] + (i - i0[p]), *more
        even = np.ones(len(s), bool)
        even[odd] = False
        s, i0, i1, wide, place, left, right, d, x0, y0, top, yl, yr, slope = (c[even] for c in (s, i0, i1, wide, place, left, right, d, x0, y0, top, yl, yr, slope))
    # heights at the sides of columns, in cells
    end = np.cumsum(wide)
    begin = end - wide
    n = len(s) and int(end[-1])
    if n:
        from_ = x0 + i0 * d
        y0l = yl - y0
        h = (y0l + (from_ - left) * slope) / d
        rows = np.repeat(np.stack([slope, h - begin * slope, place - begin, top], 1), wide, 0)
        t = np.arange(n, dtype=np.float64)
        u = t * rows[:, 0]
        u += rows[:, 1]
        u[begin] = np.where(left >= from_, y0l / d, h)
        u[end - 1] = np.where(right <= x0 + (i1 + 1) * d, (yr - y0) / d, u[end - 1])
        r = np.floor(u)
        whole = np.rint(u)
        u -= whole
        near = np.abs(u, out=u) <= NEAR
        low, high = np.minimum(r[:-1], r[1:]), np.maximum(r[:-1], r[1:])
        first, last = np.maximum(low, 0.0), np.minimum(high, rows[:-1, 3])
        t += rows[:, 2]
        if near.any():
            # no row is below the first: who comes to its lower edge from above meets it, whatever side rounding puts the end on
            zero = near & (whole == 0)
            above = (r >= 0) & ~zero
            near &= ~zero
            close = np.flatnonzero(near[:-1] | near[1:] | (zero[:-1] & ~above[1:]) | (zero[1:] & ~above[:-1]))
            p = np.searchsorted(end, close, "right")
            inner = close < end[p] - 1
            close, p = close[inner], p[inner]
            if len(close):
                first[close], last[close] = _tested(tuple(c[s[p]] for c in segs), (d[p], x0[p], y0[p], top[p] + 1), t[close] - place[p] + i0[p], low[close], high[close])
        last[end[:-1] - 1] = -1.0  # a pair's last height beside the next one's first
        met = first <= last
        t = t[:-1]
    if more is not None or not n or (float(place.max()) + columns + 1) * 4.0**bits >= 2.0**53:
        found = [more] if more is not None else []
        if n:
            found.append((t, first, last))
        t, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
        met = first <= last
        if not met.any():
            return None
        return *_coded(t[met], first[met], last[met]), int(columns), int(base)
    # unit, column, first row and length as one number
    t *= 2.0**bits
    t += first
    t *= 2.0**bits
    last -= first
    t += last
    key = t[met]
    if not len(key):
        return None
    if float(place.max() + columns) * 4.0**bits < 2.0**32:
        key = np.sort(key.astype(np.uint32)).astype(np.int64)
    else:
        key = key.astype(np.int64)
        key.sort()
    code = key >> bits
    key &= (1 << bits) - 1
    key += code
    return code, np.maximum.accumulate(key), bits, None, int(columns), int(base)


def _coded(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
    """Spans of grids too large, or segments too steep, for one number."""
    bits, names = (int(last.max()) + 2).bit_length(), None
    if (float(place.max()) + 1) * 2.0**bits >= 2.0**62:  # names of columns instead of their numbers
        names, place = np.unique(place, return_inverse=True)
    code = (place.astype(np.int64) << bits) + first.astype(np.int64)
    order = np.argsort(code)
    code = code[order]
    return code, np.maximum.accumulate(code + (last - first).astype(np.int64)[order]), bits, names


def counted(segs: Arrays, start: np.ndarray, length: np.ndarray, grids: Arrays, body: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Cells met, by unit.

    segs: x1, y1, x2, y2; start, length: each body's rows of them; grids: delta, xmin, xmax,
    ymin, ymax; body, grid: those of each unit.
    """
    out = np.zeros(len(body), np.int64)
    with np.errstate(all="ignore"):
        for lo, hi, code, upto, bits, names, columns, _ in _sorted(segs, start, length, grids, body, grid):
            new = upto - code
            new[1:] = upto[1:] - np.maximum(upto[:-1], code[1:] - 1)
            new[0] += 1
            cuts = np.arange(hi - lo + 1) * columns
            cuts = np.searchsorted(code, (cuts if names is None else np.searchsorted(names, cuts)) << bits)
            sums = np.concatenate([[0], np.cumsum(new)])[cuts]
            out[lo:hi] += sums[1:] - sums[:-1]
    return out


def merged(segs: Arrays, start: np.ndarray, length: np.ndarray, grids: Arrays, body: np.ndarray, grid: np.ndarray) -> Iterator[Arrays]:
    """Disjoint spans of each unit: pieces of (unit, column, first, last). A column of one unit is never in two pieces."""
    with np.errstate(all="ignore"):
        for lo, _, code, upto, bits, names, columns, base in _sorted(segs, start, length, grids, body, grid):
            at = np.flatnonzero(np.concatenate([[True], code[1:] > upto[:-1] + 1]))
            first, last = code[at], upto[np.concatenate([at[1:], [len(code)]]) - 1]
            place = first >> bits
            place = place if names is None else names[place].astype(np.int64)
            rows = (1 << bits) - 1
            yield lo + place // columns, place % columns + base, first & rows, last & rows
