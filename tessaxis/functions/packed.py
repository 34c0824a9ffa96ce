"""Masks of a whole batch at once: resampling, parts, holes and contours on their cells laid one after another.

Parts are found on runs of cells along rows; contours are cycles of a permutation of cell borders, put in order by pointer
doubling. So nothing loops over masks, rows or vertices.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from tessaxis.functions import images


class Masks(NamedTuple):
    """Cells by rows, mask after mask; a mask that is null or broken has no cells and is not ok."""

    data: np.ndarray
    h: np.ndarray
    w: np.ndarray
    ok: np.ndarray

    @property
    def start(self) -> np.ndarray:
        """Each mask's first cell, and the number of cells."""
        return np.r_[0, np.cumsum(self.h * self.w)]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The mask of each row of cells, and the first cell of each row (with the number of cells)."""
        owner = np.repeat(np.arange(len(self.h)), self.h)
        return owner, np.r_[0, np.cumsum(self.w[owner])]

    def with_data(self, data: np.ndarray) -> "Masks":
        return self._replace(data=np.asarray(data, np.float32))

    def taken(self, keep: np.ndarray) -> "Masks":
        """The masks that a flag for each keeps."""
        cells = np.repeat(keep, self.h * self.w)
        return Masks(self.data[cells], self.h[keep], self.w[keep], self.ok[keep])


def from_arrow(column: pa.StructArray) -> Masks:
    """Masks of a column of (h, w, data)."""
    raw = column.field("data")
    size = raw.cast(pa.large_binary())
    offsets = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    h, w = (column.field(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "w"))
    there = np.ones(len(column), bool)
    for part in (column, raw, column.field("h"), column.field("w")):
        there &= part.is_valid().to_numpy(zero_copy_only=False)
    ok = there & (h >= 0) & (w >= 0) & (np.diff(offsets) == 4 * h * w)
    data = np.frombuffer(size.buffers()[2] or b"", np.uint8)
    if ok.all():
        data = data[offsets[0] : offsets[-1]]
    else:
        data = np.concatenate([np.zeros(0, np.uint8), *(data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(ok))])
    return Masks(data.view(np.float32), np.where(ok, h, 0), np.where(ok, w, 0), ok)


def to_arrow(m: Masks) -> pa.StructArray:
    offsets = (4 * m.start).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(m.h), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m.data, np.float32))])
    return pa.StructArray.from_arrays([pa.array(m.h.astype(np.int32)), pa.array(m.w.astype(np.int32)), data], ["h", "w", "data"], mask=pa.array(~m.ok))


def resized(m: Masks, h: int, w: int, how: str) -> Masks:
    """Masks resampled to h x w, those of one shape together; empty ones fail."""
    ok = m.ok & (m.h > 0) & (m.w > 0)
    out, start = np.zeros((int(ok.sum()), h, w), np.float32), m.start
    place = np.cumsum(ok) - 1
    for hh, ww in np.unique(np.column_stack([m.h, m.w])[ok], axis=0):
        i = np.flatnonzero(ok & (m.h == hh) & (m.w == ww))
        cells = m.data[start[i][:, None] + np.arange(hh * ww)].reshape(-1, hh, ww)
        out[place[i]] = images.resize(cells, h, w, how)
    return Masks(out.ravel(), np.where(ok, h, 0), np.where(ok, w, 0), ok)


def sums(m: Masks, values: np.ndarray) -> np.ndarray:
    """The sum of a value of each cell, by mask."""
    return np.add.reduceat(np.r_[np.asarray(values, float), 0.0], m.start[:-1]) * (m.h * m.w > 0) if len(m.h) else np.zeros(0)


class Runs(NamedTuple):
    """Runs of flagged cells along rows, in raster order: cells first..last - 1, columns from..to - 1, row in the mask."""

    mask: np.ndarray
    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    column: np.ndarray


def runs(m: Masks, flag: np.ndarray, eight: bool = False) -> tuple[Runs, np.ndarray]:
    """Runs of the flagged cells, and for each the first run of its connected part."""
    owner, at = m.rows()
    edge = np.zeros(len(flag) + 1, bool)
    edge[at] = True
    first = np.flatnonzero(flag & (edge[:-1] | ~np.r_[False, flag[:-1]]))
    last = np.flatnonzero(flag & (edge[1:] | ~np.r_[flag[1:], False])) + 1
    line = np.searchsorted(at, first, "right") - 1
    top = np.r_[0, np.cumsum(m.h)]
    mask = owner[line]
    found = Runs(mask, line - top[mask], first, last, first - at[line])
    # the runs of the row above that a run touches
    wide, before = int(eight), np.maximum(line - 1, 0)
    low = np.maximum(at[before] + found.column - wide, at[before])
    high = np.minimum(at[before] + found.column + last - first + wide, at[before + 1])
    a, b = np.searchsorted(last, low, "right"), np.searchsorted(first, high, "left")
    n = np.where(found.row > 0, np.maximum(b - a, 0), 0)
    p = np.repeat(np.arange(len(first)), n)
    q = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
    return found, _united(len(first), p, q)


def _united(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least member of each one's part under links p - q."""
    root = np.arange(n)
    while True:
        a, b = root[p], root[q]
        apart = a != b
        if not apart.any():
            return root
        p, q = p[apart], q[apart]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _cells(n: int, r: Runs, chosen: np.ndarray) -> np.ndarray:
    """A flag for each of n cells: whether it is in a chosen run."""
    step = np.zeros(n + 1, np.int8)
    step[r.first[chosen]] += 1
    np.subtract.at(step, r.last[chosen], 1)
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def part_counts(m: Masks, flag: np.ndarray, eight: bool = False) -> np.ndarray:
    """The number of connected parts of each mask."""
    r, root = runs(m, flag, eight)
    return np.bincount(r.mask[root == np.arange(len(root))], minlength=len(m.h))


def holes_filled(m: Masks, flag: np.ndarray, smaller_than: int | None = None) -> np.ndarray:
    """Flags with holes filled: 4-connected unflagged parts that miss the mask's sides, or, given a size, all smaller ones."""
    r, root = runs(m, ~flag)
    if smaller_than is None:
        side = (r.row == 0) | (r.row == m.h[r.mask] - 1) | (r.column == 0) | (r.column + r.last - r.first == m.w[r.mask])
        hole = np.bincount(root, side, minlength=len(root)) == 0
    else:
        hole = np.bincount(root, r.last - r.first, minlength=len(root)) < smaller_than
    return flag | _cells(len(flag), r, hole[root])


def largest_parts(m: Masks) -> Masks:
    """Each mask's largest 4-connected part of cells over 0, the first of equals in raster order, with its holes filled."""
    r, root = runs(m, m.data > 0)
    size = np.bincount(root, r.last - r.first, minlength=len(root)).astype(np.int64)
    heads = np.flatnonzero(root == np.arange(len(root)))
    order = heads[np.lexsort((heads, -size[heads], r.mask[heads]))]
    best = np.zeros(len(root), bool)
    best[order[np.r_[True, r.mask[order][1:] != r.mask[order][:-1]]] if len(order) else order] = True
    return m.with_data(holes_filled(m, _cells(len(m.data), r, best[root])))


def cropped(m: Masks) -> tuple[Masks, np.ndarray, np.ndarray]:
    """Masks cut to the boxes of their non-zero cells, and those boxes' first rows and columns."""
    r, n = runs(m, m.data != 0)[0], len(m.h)
    big = np.iinfo(np.int64).max
    row0, col0, row1, col1 = np.full(n, big), np.full(n, big), np.full(n, -1), np.full(n, -1)
    for f, out, v in ((np.minimum, row0, r.row), (np.minimum, col0, r.column), (np.maximum, row1, r.row), (np.maximum, col1, r.column + r.last - r.first - 1)):
        f.at(out, r.mask, v)
    none = row1 < 0
    row0[none] = col0[none] = 0
    h, w = np.where(none, 0, row1 - row0 + 1), np.where(none, 0, col1 - col0 + 1)
    owner = np.repeat(np.arange(n), h)
    row = np.arange(len(owner)) - np.repeat(np.cumsum(h) - h, h) + row0[owner]
    line = m.start[owner] + row * m.w[owner] + col0[owner]
    wide = w[owner]
    cells = np.arange(wide.sum()) + np.repeat(line - (np.cumsum(wide) - wide), wide)
    return Masks(m.data[cells], h, w, m.ok), row0, col0


class _Padded(NamedTuple):
    """Masks with a rim of zeros: cells, each mask's first cell, and the length and mask of each cell's row."""

    data: np.ndarray
    start: np.ndarray
    owner: np.ndarray

    def place(self, i: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, wide = i - self.start[self.owner[i]], w[self.owner[i]] + 2
        return at // wide - 1, at % wide - 1


def _padded(m: Masks) -> _Padded:
    size = (m.h + 2) * (m.w + 2)
    start = np.cumsum(size) - size
    owner, at = m.rows()
    row = np.arange(len(owner)) - np.repeat(np.cumsum(m.h) - m.h, m.h)
    line = start[owner] + (row + 1) * (m.w[owner] + 2) + 1
    out = np.zeros(int(size.sum()), np.float32)
    out[np.repeat(line - at[:-1], m.w[owner]) + np.arange(len(m.data))] = m.data
    return _Padded(out, start, np.repeat(np.arange(len(m.h)), size))


def _leaders(after: np.ndarray) -> np.ndarray:
    """The least member of each one's cycle of a permutation."""
    least, jump = np.arange(len(after)), after
    while (least[after] != least).any():
        least, jump = np.minimum(least, least[jump]), jump[jump]
    return least


def _in_order(after: np.ndarray, leader: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The members of the chosen cycles (flags by leader), cycle after cycle, each from its leader on."""
    before = np.empty_like(after)
    before[after] = np.arange(len(after))
    own = np.arange(len(after)) == leader
    jump, rank = np.where(own, leader, before), np.where(own, 0, 1)
    while (jump != leader).any():
        rank, jump = rank + rank[jump], jump[jump]
    members = np.flatnonzero(chosen[leader])
    return members[np.lexsort((rank[members], leader[members]))]


def _firsts(mask: np.ndarray, weight: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Of each mask the head of greatest weight, the first of equals."""
    order = heads[np.lexsort((heads, -weight[heads], mask[heads]))]
    return order[np.r_[True, mask[order][1:] != mask[order][:-1]]] if len(order) else order


# Sides that a line joins in each case of four corners (0 top, 1 right, 2 bottom, 3 left), high values to its left
LINES = {1: [(0, 3)], 2: [(1, 0)], 3: [(1, 3)], 4: [(2, 1)], 5: [(0, 3), (2, 1)], 6: [(2, 0)], 7: [(2, 3)], 8: [(3, 2)], 9: [(0, 2)], 10: [(1, 0), (3, 2)], 11: [(1, 2)], 12: [(3, 1)], 13: [(0, 1)], 14: [(3, 0)]}
_LINES = np.full((16, 2, 2), -1)
for _case, _sides in LINES.items():
    _LINES[_case, : len(_sides)] = _sides


def _isolines(m: Masks, level: float) -> tuple[_Padded, np.ndarray, np.ndarray, np.ndarray]:
    """Crossings of a level with borders between cells (2 x cell, + 1 for the cell below), the next of each, their leaders."""
    p = _padded(m)
    high = np.r_[p.data > level, False].astype(np.int8)
    wide = (m.w + 2)[p.owner]
    i = np.arange(len(p.data))
    rest = i - p.start[p.owner]
    i = i[(rest % wide < wide - 1) & (rest // wide < (m.h + 1)[p.owner])]
    down = i + wide[i]
    case = high[i] + 2 * high[i + 1] + 4 * high[down + 1] + 8 * high[down]
    some = (case > 0) & (case < 15)
    i, down, lines = i[some], down[some], _LINES[case[some]]
    sides = np.column_stack([2 * i, 2 * i + 3, 2 * down, 2 * i + 1])
    ends = np.take_along_axis(sides[:, None, :].repeat(2, 1), np.maximum(lines, 0), 2)[lines[..., 0] >= 0]
    order = np.argsort(ends[:, 0])
    after = order[np.searchsorted(ends[:, 0], ends[:, 1], sorter=order)]
    return p, ends[:, 0], after, _leaders(after)


def isoline_counts(m: Masks, level: float = 0.5) -> np.ndarray:
    """The number of contours of each mask at a level."""
    p, borders, after, leader = _isolines(m, level)
    return np.bincount(p.owner[borders[leader == np.arange(len(after))] >> 1], minlength=len(m.h))


def traced_isolines(m: Masks, level: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (x, y) of each mask's longest closed contour by marching squares, and the number of them (0: none)."""
    p, borders, after, leader = _isolines(m, level)
    cell = borders >> 1
    best = np.zeros(len(after), bool)
    best[_firsts(p.owner[cell], np.bincount(leader, minlength=len(after)), np.flatnonzero(leader == np.arange(len(after))))] = True
    ring = _in_order(after, leader, best)
    # closed: each cycle's first vertex again at its end
    new = np.r_[True, leader[ring][1:] != leader[ring][:-1]] if len(ring) else np.zeros(0, bool)
    last = np.flatnonzero(np.r_[new[1:], True]) + 1 if len(ring) else np.zeros(0, int)
    ring = np.insert(ring, last, ring[new])
    i, below = cell[ring], borders[ring] & 1
    other = i + np.where(below == 1, (m.w + 2)[p.owner[i]], 1)
    a, b = p.data[i].astype(float), p.data[other].astype(float)
    row, col = p.place(i, m.w)
    part = (level - a) / (b - a)
    xy = np.column_stack([col + np.where(below == 0, part, 0.0), row + np.where(below == 1, part, 0.0)])
    order = np.argsort(p.owner[i], kind="stable")
    return xy[order], np.bincount(p.owner[i], minlength=len(m.h))


# Per side of a cell (top, right, bottom, left) the way along it clockwise and the way out, as (row, column)
ALONG, OUT = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)]), np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])


def traced_borders(m: Masks) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (x, y) of the outer border, through cell centers, of each mask's 8-connected part of largest border, and their number.

    Cells are cut to whole numbers first. Borders are open rings without collinear vertices, clockwise from the first cell.
    """
    p = _padded(m)
    on = np.trunc(p.data) != 0
    wide = (m.w + 2)[p.owner]
    cells = np.flatnonzero(on)
    step = lambda way: way[:, 0] * wide[cells][:, None] + way[:, 1]
    free = ~on[cells[:, None] + step(OUT)]
    which, side = np.nonzero(free)
    cell = cells[which]
    ahead, aslant = cell + step(ALONG)[which, side], cell + step(ALONG + OUT)[which, side]
    to = np.where(on[aslant], 4 * aslant + (side + 3) % 4, np.where(on[ahead], 4 * ahead + side, 4 * cell + (side + 1) % 4))
    after = np.searchsorted(4 * cell + side, to)
    leader = _leaders(after)
    # a cycle around a hole has a negative area
    row, col = p.place(cell, m.w)
    area = np.bincount(leader, np.where(side == 1, col + 1.0, np.where(side == 3, -col * 1.0, 0.0)), minlength=len(after))
    path = _in_order(after, leader, area > 0)
    ring, at = leader[path], cell[path]
    new = lambda v: np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
    fresh = new(ring) | new(at)
    ring, at = ring[fresh], at[fresh]
    head = np.flatnonzero(new(ring))
    tail = np.r_[head[1:], len(ring)] - 1 if len(ring) else head
    again = tail[(tail > head) & (at[tail] == at[head])]
    ring, at = np.delete(ring, again), np.delete(at, again)
    head = np.flatnonzero(new(ring))
    size = np.diff(np.r_[head, len(ring)])
    group = np.repeat(np.arange(len(head)), size)
    following, previous = np.arange(len(ring)) + 1, np.arange(len(ring)) - 1
    if len(ring):
        following[head + size - 1], previous[head] = head, head + size - 1
    row, col = p.place(at, m.w)
    x, y = col.astype(float), row.astype(float)
    areas = np.abs(np.bincount(group, x * y[following] - x[following] * y, minlength=len(head))) / 2
    chosen = np.zeros(len(head), bool)
    owner = p.owner[at[head]]
    chosen[_firsts(owner, areas, np.arange(len(head)))] = True
    dx, dy = x[following] - x, y[following] - y
    turns = (dx * dy[previous] != dy * dx[previous]) | (dx * dx[previous] + dy * dy[previous] < 0) | (size[group] < 3)
    kept = np.flatnonzero(turns & chosen[group])
    mask = owner[group[kept]]
    order = np.argsort(mask, kind="stable")
    return np.column_stack([x, y])[kept[order]], np.bincount(mask, minlength=len(m.h))


def rings(xy: np.ndarray, n: np.ndarray) -> pa.ListArray:
    """Rings as an Arrow column; those without vertices are null."""
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), points, mask=pa.array(n == 0))
