"""Batches of masks against routines on one mask."""

import numpy as np
import pyarrow as pa
import pytest

from tessaxis.functions import images, packed


def column(masks):
    rows = [None if a is None else {"h": a.shape[0], "w": a.shape[1], "data": np.ascontiguousarray(a, np.float32).tobytes()} for a in masks]
    return pa.array(rows, pa.struct([("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())]))


def shapes():
    """A ring, an L, a mask with two holes, a thin line, a pixel, diagonal parts, empty and full masks, noise, fractional cells."""
    yy, xx = np.mgrid[:30, :24]
    d = np.hypot(yy - 14, xx - 11)
    bent = np.zeros((12, 9))
    bent[2:10, 2:4] = bent[8:10, 2:8] = 1
    holed = np.ones((9, 14))
    holed[2:4, 2:4] = holed[5:7, 8:11] = 0
    line, dot = np.zeros((5, 8)), np.zeros((4, 4))
    line[2, 1:7] = dot[3, 0] = 1
    rng = np.random.default_rng(3)
    yield from ((d < 10) & (d > 5), bent, holed, line, dot, np.eye(6), np.zeros((3, 4)), np.ones((4, 3)), np.zeros((0, 0)), np.eye(5)[::-1] + np.eye(5))
    for i in range(60):
        h, w = rng.integers(1, 18, 2)
        yield rng.random((h, w)) < rng.random() if i % 3 else np.round(rng.random((h, w)), 2)


def split(xy, n):
    return np.split(xy, np.cumsum(n)[:-1])


def test_masks_in_batches_as_one_by_one():
    masks = [np.asarray(a, np.float32) for a in shapes()]
    m = packed.from_arrow(column(masks))
    assert [r["data"] for r in packed.to_arrow(m).to_pylist()] == [a.tobytes() for a in masks]
    parts, (small, row0, col0) = packed.largest_parts(m), packed.cropped(m)
    filled = packed.holes_filled(m, m.data > 0, 4)
    lines, borders = split(*packed.traced_isolines(m)), split(*packed.traced_borders(m))
    counts, contours = packed.part_counts(m, m.data > 0, eight=True), packed.isoline_counts(m)
    total = packed.sums(m, m.data)
    for i, a in enumerate(masks):
        at = slice(m.start[i], m.start[i + 1])
        assert total[i] == pytest.approx(a.sum(), abs=1e-4)
        if not a.size:
            assert not len(lines[i]) and not len(borders[i])
            continue
        assert (parts.data[at].reshape(a.shape) == images.largest_component(a > 0)).all()
        assert (filled[at].reshape(a.shape) == images.fill_holes(a > 0, 4)).all()
        cut, r, c = images.crop(a)
        assert small.data[small.start[i] : small.start[i + 1]].tobytes() == cut.tobytes() and (row0[i], col0[i]) == (r, c)
        assert counts[i] == images.components(a > 0, eight=True)[1] and contours[i] == len(images.isoline(a))
        line, border = images.trace_isoline(a), images.trace_border(a)
        assert len(lines[i]) == (0 if line is None else len(line)) and (line is None or np.allclose(lines[i], line))
        assert len(borders[i]) == (0 if border is None else len(border)) and (border is None or (borders[i] == border).all()), a


@pytest.mark.parametrize("how", ["area", "nearest", "bilinear", "cubic"])
def test_resized_batch(how):
    masks = [np.asarray(a, np.float32) for a in shapes()]
    m = packed.resized(packed.from_arrow(column(masks)), 7, 5, how)
    for i, a in enumerate(masks):
        assert m.ok[i] == (a.size > 0)
        if a.size:
            assert np.allclose(m.data[m.start[i] : m.start[i + 1]].reshape(7, 5), images.resize(a, 7, 5, how), atol=1e-5)


def test_broken_masks():
    ok = np.ones((2, 2), np.float32)
    rows = column([ok, None, ok]).to_pylist() + [{"h": 3, "w": 2, "data": ok.tobytes()}, {"h": 2, "w": 2, "data": None}, {"h": None, "w": 2, "data": b""}]
    m = packed.from_arrow(pa.array(rows, column([]).type))
    assert m.ok.tolist() == [True, False, True, False, False, False] and len(m.data) == 8
    assert packed.to_arrow(m).is_valid().to_pylist() == m.ok.tolist()
    assert packed.traced_isolines(m)[1].tolist() == [9, 0, 9, 0, 0, 0] and packed.traced_borders(m)[1].tolist() == [4, 0, 4, 0, 0, 0]
    none = packed.from_arrow(column([]))
    assert len(packed.traced_borders(none)[0]) == len(packed.traced_isolines(none)[0]) == len(packed.largest_parts(none).h) == 0
