"""Many small arrangements at once: DE-9IM, areal overlay and validity of whole columns.

The arrangement of ``plane.Nodes`` for many rows side by side in the same arrays, in which only what is of one row meets. A row
with more than ``MOST`` segments, with places nearly but not quite equal or with an outline that doesn't close is left undecided: it
goes through ``plane`` by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from .model import POINT, POLYGON, Geometry
from .plane import _Parts, _thin, assemble, dimension, orient

#: Segments of a row, and pairs of a row's segments that are held at once.
MOST, PAIRS = 96, 200_000
NONE = np.empty((0, 2))
NO_ROWS = np.empty(0, np.int64)


def spread(at: np.ndarray, many: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (many[0] numbers), at[1], ..."""
    return np.repeat(at - (np.cumsum(many) - many), many) + np.arange(many.sum())


@dataclass
class Shapes:
    """Rings, lines, points and line ends of one argument, each with its row and sorted by it; boxes (NaN: empty) and dimensions."""

    n: int
    box: np.ndarray
    dim: np.ndarray
    rings: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    ring_row: np.ndarray = field(default_factory=lambda: NO_ROWS)
    lines: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    line_row: np.ndarray = field(default_factory=lambda: NO_ROWS)
    points: np.ndarray = field(default_factory=lambda: NONE)
    point_row: np.ndarray = field(default_factory=lambda: NO_ROWS)
    ends: np.ndarray = field(default_factory=lambda: NONE)
    end_row: np.ndarray = field(default_factory=lambda: NO_ROWS)

    def take(self, rows: np.ndarray) -> Shapes:
        """The given rows (ascending) with new numbers."""
        new = np.full(self.n, -1)
        new[rows] = np.arange(len(rows))
        out = Shapes(len(rows), self.box[rows], self.dim[rows])
        for what, row in (("rings", "ring_row"), ("lines", "line_row"), ("points", "point_row"), ("ends", "end_row")):
            at = new[getattr(self, row)]
            setattr(out, what, getattr(self, what)[at >= 0])
            setattr(out, row, at[at >= 0])
        return out

    def segments(self) -> np.ndarray:
        return np.bincount(self.ring_row, minlength=self.n) + np.bincount(self.line_row, minlength=self.n)


def of_flat(kind: int, xy: np.ndarray, runs: np.ndarray, rows: np.ndarray, box: np.ndarray) -> Shapes | None:
    """Shapes of a column of one plain kind (see functions.vector.Flat); None if a ring is open."""
    n = len(rows) - 1
    out = Shapes(n, box, np.full(n, kind - 1))
    run_row = np.repeat(np.arange(n), np.diff(rows))
    if kind == POINT:
        out.points, out.point_row = xy, run_row
        return out
    first, last = xy[runs[:-1]], xy[runs[1:] - 1]
    shut = (first == last).all(1)
    inner = np.ones(len(xy), bool)
    inner[runs[1:] - 1] = False
    at = np.flatnonzero(inner)
    segments, row = np.hstack([xy[at], xy[at + 1]]), np.repeat(run_row, np.diff(runs) - 1)
    if kind == POLYGON:
        if not shut.all():
            return None
        out.rings, out.ring_row = segments, row
        return out
    out.lines, out.line_row = segments, row
    dot = (np.minimum.reduceat(xy, runs[:-1]) == np.maximum.reduceat(xy, runs[:-1])).all(1)
    out.points, out.point_row = first[dot], run_row[dot]
    out.ends, out.end_row = np.stack([first, last], 1)[~shut].reshape(-1, 2), np.repeat(run_row[~shut], 2)
    return out


def of_geometries(gs: list[Geometry]) -> Shapes:
    box = np.array([g.box() or (np.nan,) * 4 for g in gs], float).reshape(-1, 4)
    out, parts = Shapes(len(gs), box, np.array([dimension(g) for g in gs], np.int64)), [_Parts(g) for g in gs]
    for what, row, own in (("rings", "ring_row", "ring_segments"), ("lines", "line_row", "line_segments"), ("points", "point_row", "points"), ("ends", "end_row", "ends")):
        found = [getattr(p, own) for p in parts]
        if any(map(len, found)):
            setattr(out, what, np.concatenate([x for x in found if len(x)]))
            setattr(out, row, np.repeat(np.arange(len(gs)), [len(x) for x in found]))
    return out


class Arrangements:
    """``plane.Nodes`` of many rows. ``odd``: rows that are undecided."""

    def __init__(self, n: int, sources: list[tuple[np.ndarray, np.ndarray]], extra: list[tuple[np.ndarray, np.ndarray]] = ()):
        s, row = np.concatenate([x for x, _ in sources]), np.concatenate([r for _, r in sources])
        owner = np.repeat(np.arange(len(sources)), [len(x) for x, _ in sources])
        keep = np.flatnonzero((s[:, :2] != s[:, 2:]).any(1))
        keep = keep[np.argsort(row[keep], kind="stable")]
        s, row, owner = s[keep], row[keep], owner[keep]
        e, e_row = np.concatenate([NONE, *[x for x, _ in extra]]), np.concatenate([NO_ROWS, *[r for _, r in extra]])
        start = np.searchsorted(row, np.arange(n + 1))
        size = np.zeros(n)
        np.maximum.at(size, row, np.abs(s).max(1, initial=0))
        np.maximum.at(size, e_row, np.abs(e).max(1, initial=0))
        tol = np.maximum(size, 1e-300) * 1e-14
        self.n, self.odd = n, ~np.isfinite(size)
        cut_seg, cut_pt = [np.arange(len(s))] * 2, [s[:, :2], s[:, 2:]]
        lo, hi = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
        many = start[row + 1] - np.arange(len(s)) - 1
        i, j = np.repeat(np.arange(len(s)), many), spread(np.arange(1, len(s) + 1), many)
        ok = (lo[i] <= hi[j]).all(1) & (lo[j] <= hi[i]).all(1)
        i, j = i[ok], j[ok]
        if len(i):
            later = lo[i, 0] > lo[j, 0]  # the same crossings to the last digit as in a sweep
            i, j = np.where(later, j, i), np.where(later, i, j)
            a, b, c, d = s[i, :2], s[i, 2:], s[j, :2], s[j, 2:]
            o1, o2 = (orient(a[:, 0], a[:, 1], b[:, 0], b[:, 1], q[:, 0], q[:, 1]) for q in (c, d))
            o3, o4 = (orient(c[:, 0], c[:, 1], d[:, 0], d[:, 1], q[:, 0], q[:, 1]) for q in (a, b))
            k = np.flatnonzero((o1 * o2 < 0) & (o3 * o4 < 0))
            r, t = b[k] - a[k], d[k] - c[k]
            with np.errstate(divide="ignore", invalid="ignore"):
                f = ((c[k, 0] - a[k, 0]) * t[:, 1] - (c[k, 1] - a[k, 1]) * t[:, 0]) / (r[:, 0] * t[:, 1] - r[:, 1] * t[:, 0])
                meet = a[k] + f[:, None] * r
            fine = np.isfinite(meet).all(1)
            cut_seg += [i[k[fine]], j[k[fine]]]
            cut_pt += [meet[fine], meet[fine]]
            for o, q, at in ((o1, c, i), (o2, d, i), (o3, a, j), (o4, b, j)):
                on = np.flatnonzero(o == 0)
                on = on[((q[on] >= lo[at[on]]) & (q[on] <= hi[at[on]])).all(1)]
                cut_seg.append(at[on])
                cut_pt.append(q[on])
        if len(e):
            many = start[e_row + 1] - start[e_row]
            i, j = np.repeat(np.arange(len(e)), many), spread(start[e_row], many)
            ok = ((lo[j] <= e[i]) & (hi[j] >= e[i])).all(1)
            i, j = i[ok], j[ok]
            on = orient(s[j, 0], s[j, 1], s[j, 2], s[j, 3], e[i, 0], e[i, 1]) == 0
            cut_seg.append(j[on])
            cut_pt.append(e[i[on]])
        seg, pt = np.concatenate(cut_seg), np.concatenate(cut_pt)
        every, every_row = np.concatenate([e, pt]), np.concatenate([e_row, row[seg]])
        order = np.lexsort((every[:, 1], every[:, 0], every_row))
        p, p_row = every[order], every_row[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]).any(1) | (p_row[1:] != p_row[:-1])
        ids = np.empty(len(p), np.int64)
        ids[order] = np.cumsum(new) - 1
        self.pts, self.row = p[new], p_row[new]
        near, step = np.arange(len(self.pts)), 0
        while len(near):
            step += 1
            near = near[near + step < len(self.pts)]
            near = near[self.row[near] == self.row[near + step]]
            near = near[self.pts[near + step, 0] - self.pts[near, 0] <= tol[self.row[near]]]
            self.odd[self.row[near[np.abs(self.pts[near + step, 1] - self.pts[near, 1]) <= tol[self.row[near]]]]] = True
        self.extra, node = ids[: len(e)], ids[len(e) :]
        along = ((self.pts[node] - s[seg, :2]) * (s[seg, 2:] - s[seg, :2])).sum(1)
        order = np.lexsort((along, seg))
        seg, node = seg[order], node[order]
        ok = (seg[1:] == seg[:-1]) & (node[1:] != node[:-1])
        u, v, own = node[:-1][ok], node[1:][ok], owner[seg[:-1][ok]]
        flip = u > v
        total = max(1, len(self.pts))
        pair, inverse = np.unique(np.where(flip, v, u) * total + np.where(flip, u, v), return_inverse=True)
        self.u, self.v = pair // total, pair % total
        self.piece_row = self.row[self.u]
        m, k = len(pair), len(sources)
        self.weight = np.bincount(own * m + inverse, np.where(flip, -1.0, 1.0), k * m).astype(np.int64).reshape(k, m)
        self.count = np.bincount(own * m + inverse, minlength=k * m).reshape(k, m)
        self.mid = (self.pts[self.u] + self.pts[self.v]) / 2

    def left_of(self, strength: np.ndarray, p: np.ndarray, p_row: np.ndarray, skip: bool) -> np.ndarray:
        """As in ``plane.Nodes``."""
        use = np.flatnonzero(strength)
        start = np.searchsorted(self.piece_row[use], np.arange(self.n + 1))
        many = start[p_row + 1] - start[p_row]
        i, j = np.repeat(np.arange(len(p)), many), use[spread(start[p_row], many)]
        if skip:
            ok = i != j
            i, j = i[ok], j[ok]
            level = (self.pts[self.u[i], 1] == self.pts[self.v[i], 1]).astype(np.int64)
        else:
            level = np.zeros(len(i), np.int64)
        a, b = self.u[j], self.v[j]
        ay, by, qy = self.pts[a, 1 - level], self.pts[b, 1 - level], p[i, 1 - level]
        rise, fall = (ay <= qy) & (qy < by), (by <= qy) & (qy < ay)
        k = np.flatnonzero(rise | fall)
        level, up = level[k], rise[k]
        side = orient(self.pts[a[k], level], ay[k], self.pts[b[k], level], by[k], p[i[k], level], qy[k])
        hit = np.where(up, side > 0, side < 0)
        return np.bincount(i[k[hit]], np.where(up[hit], 1.0, -1.0) * strength[j[k[hit]]], len(p)).astype(np.int64)

    def sides(self, k: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
        """As in ``plane.Nodes``."""
        strength = self.count[k] % 2 if rule == "odd" else self.weight[k]
        rayward = self.left_of(strength, self.mid, self.piece_row, True)
        a, b = self.pts[self.u], self.pts[self.v]
        level = a[:, 1] == b[:, 1]
        left = np.where(level, b[:, 0] > a[:, 0], b[:, 1] < a[:, 1])
        if rule == "odd":
            near, far = rayward % 2 != 0, (rayward + strength) % 2 != 0
        else:
            turn = np.where(level, np.where(b[:, 0] > a[:, 0], 1, -1), np.where(b[:, 1] > a[:, 1], 1, -1))
            wind = np.where(level, -rayward, rayward)
            near, far = wind > 0, wind + np.where(level, -turn, turn) * strength > 0
        return np.where(left, near, far), np.where(left, far, near)


def _chunks(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows with few segments, so many at a time that the pairs held are bounded."""
    rows = np.flatnonzero(sizes <= MOST)
    at = np.cumsum((sizes[rows] + 4) ** 2) // PAIRS
    yield from np.split(rows, np.flatnonzero(np.diff(at)) + 1)


def relate(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """DE-9IM of each row, as (rows, 9) dimensions (-1: F), and which rows are decided."""
    out, sure = np.full((a.n, 9), -1), np.zeros(a.n, bool)
    for rows in _chunks(a.segments() + b.segments()):
        if len(rows):
            out[rows], sure[rows] = _relate(a.take(rows), b.take(rows))
    return out, sure


def _relate(a: Shapes, b: Shapes) -> tuple[np.ndarray, np.ndarray]:
    extra = [(a.points, a.point_row), (b.points, b.point_row), (a.ends, a.end_row), (b.ends, b.end_row)]
    n = Arrangements(a.n, [(a.rings, a.ring_row), (a.lines, a.line_row), (b.rings, b.ring_row), (b.lines, b.line_row)], extra)
    own = np.split(n.extra, np.cumsum([len(x) for x, _ in extra])[:-1])
    m = np.full((a.n, 3, 3), -1)
    m[:, 2, 2] = 2

    def where(ring: int, line: int, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        left, right = n.sides(ring, "odd")
        edge = n.count[ring] % 2 == 1
        piece = np.where(edge, 1, np.where(left, 0, np.where(n.count[line] > 0, 0, 2)))
        node = np.where(n.left_of(n.count[ring] % 2, n.pts, n.row, False) % 2 != 0, 0, 2)
        on_line, end, dot, rim = (np.zeros(len(n.pts), bool) for _ in range(4))
        on_line[n.u[n.count[line] > 0]] = on_line[n.v[n.count[line] > 0]] = True
        end[ends] = dot[points] = True
        node = np.where(node == 0, 0, np.where(end & on_line, 1, np.where(on_line | dot, 0, 2)))
        rim[n.u[edge]] = rim[n.v[edge]] = True
        return np.where(rim, 1, node), piece, left, right

    an, ae, al, ar = where(0, 1, own[0], own[2])
    bn, be, bl, br = where(2, 3, own[1], own[3])
    np.maximum.at(m, (n.row, an, bn), 0)
    np.maximum.at(m, (n.piece_row, ae, be), 1)
    for p, q in ((al, bl), (ar, br)):
        np.maximum.at(m, (n.piece_row, np.where(p, 0, 2), np.where(q, 0, 2)), 2)
    return m.reshape(-1, 9), ~n.odd


def matches(m: np.ndarray, pattern: str) -> np.ndarray:
    out = np.ones(len(m), bool)
    for k, p in enumerate(pattern):
        out &= True if p == "*" else m[:, k] >= 0 if p in "Tt" else m[:, k] < 0 if p in "Ff" else m[:, k] == int(p) if p in "012" else False
    return out


def _rings(n: Arrangements, keep: np.ndarray, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of the rings that have the result on their left (not closed), where each begins, its row and its signed area."""
    start, end = np.where(forward, n.u, n.v)[keep], np.where(forward, n.v, n.u)[keep]
    balance = np.bincount(start, minlength=len(n.pts)) - np.bincount(end, minlength=len(n.pts))
    n.odd[n.row[balance != 0]] = True
    fine = ~n.odd[n.row[start]]
    start, end = start[fine], end[fine]
    way = n.pts[end] - n.pts[start]
    angle, back = np.arctan2(way[:, 1], way[:, 0]), np.arctan2(-way[:, 1], -way[:, 0])
    order = np.argsort(start, kind="stable")
    first = np.searchsorted(start[order], end)
    many = np.searchsorted(start[order], end, side="right") - first
    after = order[np.minimum(first, len(order) - 1)] if len(order) else order
    several = np.flatnonzero(many > 1)
    if len(several):  # the sharpest turn to the left of where we came from keeps faces apart
        k, o = np.repeat(several, many[several]), order[spread(first[several], many[several])]
        turn = (back[k] - angle[o]) % (2 * np.pi)
        best = np.lexsort((np.where(turn == 0, 2 * np.pi, turn), k))
        after[several] = o[best[np.searchsorted(k[best], several)]]
    once = np.bincount(after, minlength=len(start)) == 1
    if not once.all():
        n.odd[n.row[start[~once]]] = True
        fine = ~n.odd[n.row[start]]
        new = np.cumsum(fine) - 1
        start, after = start[fine], new[after[fine]]
    lead, jump = np.arange(len(start)), after.copy()
    longest = int(np.bincount(n.row[start]).max(initial=0)) if len(start) else 0
    for _ in range(max(1, longest).bit_length()):
        lead, jump = np.minimum(lead, lead[jump]), jump[jump]
    place, at, step = np.zeros(len(start), np.int64), np.unique(lead), 0
    while len(at):
        place[at] = step
        step += 1
        at = after[at]
        at = at[lead[at] != at]
    order = np.lexsort((place, lead))
    xy, lead, row = n.pts[start[order]], lead[order], n.row[start[order]]

    def runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else NO_ROWS
        return begin, np.diff(np.append(begin, len(of)))

    begin, many = runs(lead)
    whole = np.repeat(many > 2, many)
    xy, lead, row = xy[whole], lead[whole], row[whole]
    begin, many = runs(lead)
    if not len(xy):
        return xy, begin, NO_ROWS, np.empty(0)
    before, following = np.arange(len(xy)) - 1, np.arange(len(xy)) + 1
    before[begin], following[begin + many - 1] = begin + many - 1, begin
    p, q = xy[before], xy[following]
    bend = orient(p[:, 0], p[:, 1], xy[:, 0], xy[:, 1], q[:, 0], q[:, 1]) != 0
    bend |= np.repeat(np.add.reduceat(bend.astype(np.int64), begin) <= 2, many)
    xy, lead, row = xy[bend], lead[bend], row[bend]
    begin, many = runs(lead)
    own = xy - np.repeat(xy[begin], many, axis=0)
    following = np.arange(len(xy)) + 1
    following[begin + many - 1] = begin
    area = np.add.reduceat(own[:, 0] * own[following, 1] - own[following, 0] * own[:, 1], begin) / 2
    return xy, begin, row[begin], area


def combine(n_rows: int, sources: list[tuple[np.ndarray, np.ndarray]], rule: str, keep: Callable, holes: bool = True) -> list[list[list[np.ndarray]] | None]:
    """``plane.combine`` of each row: polygons (without ``holes``: their shells alone), or None for a row that is undecided."""
    out: list[list[list[np.ndarray]] | None] = [None] * n_rows
    sizes = sum(np.bincount(r, minlength=n_rows) for _, r in sources)
    for rows in _chunks(sizes):
        if not len(rows):
            continue
        new = np.full(n_rows, -1)
        new[rows] = np.arange(len(rows))
        own = [(s[new[r] >= 0], new[r][new[r] >= 0]) for s, r in sources]
        n = Arrangements(len(rows), own)
        sides = [n.sides(k, rule) for k in range(len(own))]
        left, right = keep(*[s[0] for s in sides]), keep(*[s[1] for s in sides])
        xy, begin, row, area = _rings(n, left != right, left)
        found: list[list] = [[] for _ in rows]
        many = np.diff(np.append(begin, len(xy)))
        shut = np.insert(xy, begin + many, xy[begin], axis=0) if len(begin) else xy
        begin = begin + np.arange(len(begin))
        holed = np.zeros(len(rows), bool)
        holed[row[area < 0]] = holes
        for k in np.lexsort((area, row))[: len(row)].tolist():
            if area[k] > 0 and not holed[row[k]]:
                found[row[k]].append([shut[begin[k] : begin[k] + many[k] + 1]])
        for k in np.flatnonzero(holed[row]).tolist():
            found[row[k]].append(shut[begin[k] : begin[k] + many[k] + 1])
        for k, r in enumerate(rows.tolist()):
            out[r] = None if n.odd[k] else assemble(found[k]) if holed[k] else found[k]
    return out


def locate(n: int, rings: np.ndarray, ring_row: np.ndarray, p: np.ndarray, p_row: np.ndarray) -> np.ndarray:
    """``plane.Edges.locate`` of points against the rings of their own rows."""
    start = np.searchsorted(ring_row, np.arange(n + 1))
    many = start[p_row + 1] - start[p_row]
    i, j = np.repeat(np.arange(len(p)), many), spread(start[p_row], many)
    near = (p[i, 1] >= np.minimum(rings[j, 1], rings[j, 3])) & (p[i, 1] <= np.maximum(rings[j, 1], rings[j, 3]))
    i, j = i[near], j[near]
    q, a, b = p[i], rings[j, :2], rings[j, 2:]
    side = orient(a[:, 0], a[:, 1], b[:, 0], b[:, 1], q[:, 0], q[:, 1])
    on = (side == 0) & (q[:, 0] >= np.minimum(a[:, 0], b[:, 0])) & (q[:, 0] <= np.maximum(a[:, 0], b[:, 0]))
    crossing = (a[:, 1] <= q[:, 1]) & (q[:, 1] < b[:, 1]) & (side > 0) | (b[:, 1] <= q[:, 1]) & (q[:, 1] < a[:, 1]) & (side < 0)
    out = np.where(np.bincount(i, crossing, len(p)).astype(np.int64) % 2 == 1, 1, -1)
    return np.where(np.bincount(i, on, len(p)) > 0, 0, out)


def _crossed(ring: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which rings (numbers of segments (n, 4), in order, of closed rings without repeats) meet themselves."""
    rings = int(ring.max(initial=-1)) + 1
    start = np.searchsorted(ring, np.arange(rings + 1))
    many = start[ring + 1] - np.arange(len(s)) - 1
    i, j = np.repeat(np.arange(len(s)), many), spread(np.arange(1, len(s) + 1), many)
    lo, hi = np.minimum(s[:, :2], s[:, 2:]), np.maximum(s[:, :2], s[:, 2:])
    ok = (lo[i] <= hi[j]).all(1) & (lo[j] <= hi[i]).all(1)
    i, j = i[ok], j[ok]
    a, b, c, d = s[i, :2], s[i, 2:], s[j, :2], s[j, 2:]
    o = [orient(p[:, 0], p[:, 1], q[:, 0], q[:, 1], r[:, 0], r[:, 1]) for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))]
    hit = (o[0] * o[1] <= 0) & (o[2] * o[3] <= 0)
    next_ = j == i + 1
    neighbours = next_ | (i == start[ring[i]]) & (j == start[ring[i] + 1] - 1)
    line = (o[0] == 0) & (o[1] == 0) & (o[2] == 0) & (o[3] == 0)
    shared, p, q = np.where(next_[:, None], b, a), np.where(next_[:, None], a, b), np.where(next_[:, None], d, c)
    folded = line & (((p - shared) * (q - shared)).sum(1) > 0)
    bad = np.zeros(rings, bool)
    bad[ring[i[hit & (~neighbours | folded)]]] = True
    return bad


def invalid_reasons(xy: np.ndarray, runs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """``shape.invalid_reason`` of a column of plain polygons, and which rows are decided; None if a ring is open."""
    n, many = len(rows) - 1, np.diff(runs)
    if not (xy[runs[:-1]] == xy[runs[1:] - 1]).all() or not np.isfinite(xy).all():
        return None
    out, sure = np.full(n, None, object), np.zeros(n, bool)
    ring, ring_row = np.repeat(np.arange(len(many)), many), np.repeat(np.arange(n), np.diff(rows))
    order = np.lexsort((xy[:, 1], xy[:, 0], ring))
    p, of = xy[order], ring[order]
    distinct = np.bincount(of[np.concatenate([[True], (p[1:] != p[:-1]).any(1) | (of[1:] != of[:-1])])], minlength=len(many))
    inner = np.ones(len(xy), bool)
    inner[runs[1:] - 1] = False
    at = np.flatnonzero(inner)
    at = at[(xy[at] != xy[at + 1]).any(1)]
    s, of = np.hstack([xy[at], xy[at + 1]]), ring[at]
    row_of = ring_row[of]
    small = np.bincount(row_of, minlength=n) <= MOST
    holes = np.diff(rows) - 1
    for part in _chunks(np.where(small & (holes <= 1), np.bincount(row_of, minlength=n), MOST + 1)):
        if not len(part):
            continue
        mine = np.zeros(n, bool)
        mine[part] = True
        k = np.flatnonzero(mine[row_of])
        number, own = np.unique(of[k], return_inverse=True)
        crossed = np.zeros(len(many), bool)
        crossed[number] = _crossed(own, s[k])
        sure[part] = True
        for r in np.flatnonzero(mine[ring_row])[::-1].tolist():  # the first ring's fault is told
            if distinct[r] < 3:
                out[ring_row[r]] = "Too few points in geometry component"
            elif crossed[r]:
                out[ring_row[r]] = "Self-intersection"
        left = part[(holes[part] == 1) & np.array([out[r] is None for r in part.tolist()], bool)]
        if len(left):
            new = np.full(n, -1)
            new[left] = np.arange(len(left))
            k = np.flatnonzero(new[row_of] >= 0)
            shell = of[k] == rows[row_of[k]]
            _holed(s[k[shell]], new[row_of[k[shell]]], s[k[~shell]], new[row_of[k[~shell]]], left, out, sure)
    return out, sure


def _holed(shell: np.ndarray, shell_row: np.ndarray, hole: np.ndarray, hole_row: np.ndarray, rows: np.ndarray, out: np.ndarray, sure: np.ndarray) -> None:
    """The reasons of polygons of one hole whose rings are simple."""
    n = len(rows)
    probe, probe_row = np.concatenate([hole[:, :2], (hole[:, :2] + hole[:, 2:]) / 2]), np.tile(hole_row, 2)
    within = locate(n, shell, shell_row, probe, probe_row) >= 0
    outside, shared = np.zeros(n, bool), np.zeros(n, bool)
    outside[probe_row[~within]] = True
    own = Arrangements(n, [(shell, shell_row), (hole, hole_row)])
    shared[own.piece_row[(own.count > 0).all(0) | (own.count > 1).any(0)]] = True
    whole = combine(n, [(np.concatenate([shell, hole]), np.concatenate([shell_row, hole_row]))], "odd", lambda x: x, False)
    for k, r in enumerate(rows.tolist()):
        if own.odd[k] or whole[k] is None:
            sure[r] = False
        else:
            out[r] = "Hole lies outside shell" if outside[k] else "Self-intersection" if shared[k] else "Interior is disconnected" if len(whole[k]) > 1 else None


def convex_buffers(xy: np.ndarray, runs: np.ndarray, rows: np.ndarray, d: np.ndarray, quarter: int = 16) -> list[np.ndarray | None]:
    """The outlines that ``plane.buffer`` gives closed convex rings without holes for distances above 0; None for other rows.

    Around a corner the outline takes the side of the edge before, the corners of the circle up to the side of the edge after, and that.
    """
    n, steps = len(rows) - 1, 4 * quarter
    many = np.diff(runs)
    out: list[np.ndarray | None] = [None] * n
    ring_row = np.repeat(np.arange(n), np.diff(rows))
    fine = (np.diff(rows)[ring_row] == 1) & (many > 3) & (xy[runs[:-1]] == xy[runs[1:] - 1]).all(1) & (d[ring_row] > 0) & np.isfinite(d[ring_row])
    rings = np.flatnonzero(fine)
    for rings in np.split(rings, np.flatnonzero(np.diff(np.cumsum(many[rings]) // 20_000)) + 1):
        if not len(rings):
            continue
        size = many[rings] - 1
        begin = np.cumsum(size) - size
        of = np.repeat(np.arange(len(rings)), size)
        p = xy[spread(runs[rings], size)]
        after, before = np.arange(len(p)) + 1, np.arange(len(p)) - 1
        after[begin + size - 1], before[begin] = begin, begin + size - 1
        own = p - p[begin][of]
        back = np.add.reduceat(own[:, 0] * own[after, 1] - own[after, 0] * own[:, 1], begin) < 0
        p = np.where(back[of, None], p[begin[of] + (begin + size - 1)[of] - np.arange(len(p))], p)  # counter-clockwise
        bend = orient(p[before, 0], p[before, 1], p[:, 0], p[:, 1], p[after, 0], p[after, 1])
        way = p[after] - p
        turn = np.arctan2(way[:, 1], way[:, 0])
        theta = (turn - turn[before]) % (2 * np.pi)
        convex = (np.minimum.reduceat(bend, begin) > 0) & (np.abs(np.add.reduceat(theta, begin) - 2 * np.pi) < 1e-6)
        far = d[ring_row[rings]][of]
        bearing = 2 * np.pi * np.arange(steps) / steps
        circle = np.stack([np.cos(bearing), np.sin(bearing)], 1)
        normal = (turn - np.pi / 2) % (2 * np.pi)
        close = np.rint(normal / (2 * np.pi / steps)).astype(np.int64)
        exact = np.abs(close * (2 * np.pi / steps) - normal) <= 1e-9
        with np.errstate(invalid="ignore", divide="ignore"):
            side = far[:, None] * np.stack([way[:, 1], -way[:, 0]], 1) / np.hypot(way[:, 0], way[:, 1])[:, None]
        side = np.where(exact[:, None], far[:, None] * circle[close % steps], side)
        first = np.floor(normal[before] / (2 * np.pi / steps)).astype(np.int64)
        k = first[:, None] + np.arange(steps // 2 + 2)
        apart = k * (2 * np.pi / steps) - normal[before][:, None]
        between = (apart > 1e-9) & (apart < theta[:, None] - 1e-9)
        dent = ~between.any(1) & ~exact & ~exact[before]  # two chords that cross: left to the arrangement
        convex[of[dent]] = False
        arc = p[:, None] + far[:, None, None] * circle[k % steps]
        around = np.concatenate([(p + side[before])[:, None], arc, (p + side)[:, None]], 1)
        yes = np.ones((len(p), 1), bool)
        place = np.concatenate([yes, between, yes], 1)
        line, line_ring = around[place], np.repeat(of, place.sum(1))
        at = np.searchsorted(line_ring, np.arange(len(rings) + 1))
        for r in np.flatnonzero(convex).tolist():
            ring = line[at[r] : at[r + 1]]
            ring = ring[(ring != np.roll(ring, 1, 0)).any(1)]
            low = int(np.lexsort((ring[:, 1], ring[:, 0]))[0])
            if tuple(ring[(low + 1) % len(ring)]) > tuple(ring[low - 1]):
                low -= 1  # the arrangement's first piece leads to the lowest corner, not from it
            ring = _thin(np.roll(ring, -low, 0)[[*range(len(ring)), 0]])
            out[int(ring_row[rings[r]])] = ring
    return out
