"""Column functions on rings (ARRAY<STRUCT<x, y>>) and boxes (STRUCT<xmin, ymin, xmax, ymax>).

Null rings give null; empty rings are kept empty. Polygons of pixels have x = column and y = row.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((xmin, "xmin"), (ymin, "ymin"), (xmax, "xmax"), (ymax, "ymax"))))


def xs(ring: Column) -> Column:
    return F.transform(ring, lambda v: v["x"])


def ys(ring: Column) -> Column:
    return F.transform(ring, lambda v: v["y"])


def close_ring(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end, unless it is closed already."""
    return F.when((F.size(ring) == 0) | (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1))), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def rescale(ring: Column, mask_height: Column, slice_size: float) -> Column:
    """From the frame of a mask to that of its slice; both axes are divided by the mask's height."""
    return F.transform(ring, lambda v: point(v["x"] / mask_height * slice_size, v["y"] / mask_height * slice_size))


def shift(ring: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda v: point(v["x"] + dx, v["y"] + dy))


def well_inside(ring: Column, slice_size: float, margin: float = 0.05) -> Column:
    """All vertices lie in the middle of the slice, bounds included."""
    low, high = margin * slice_size, (1 - margin) * slice_size
    return (F.array_min(xs(ring)) >= low) & (F.array_max(xs(ring)) <= high) & (F.array_min(ys(ring)) >= low) & (F.array_max(ys(ring)) <= high)


def off_edges(ring: Column, height: float, width: float) -> Column:
    """No vertex lies on the outer border of the slice's pixels."""
    return ~F.exists(ring, lambda v: (v["x"] == -0.5) | (v["y"] == -0.5) | (v["x"] == width - 0.5) | (v["y"] == height - 0.5))


def demoted(score: Column, inside: Column, low: float = 0.10) -> Column:
    """The score of detections near a slice's edge is lowered; this comes after the confidence filter."""
    return F.when(inside, score).otherwise(F.lit(low))


def georeference(ring: Column, t: Column) -> Column:
    """Pixel ring to closed map ring by the affine struct t (a, b, c, d, e, f), at pixel centres."""
    to_map = lambda v: point(t["a"] * (v["x"] + 0.5) + t["b"] * (v["y"] + 0.5) + t["c"], t["d"] * (v["x"] + 0.5) + t["e"] * (v["y"] + 0.5) + t["f"])
    return close_ring(F.transform(ring, to_map))


def bounds(ring: Column) -> Column:
    return box(F.array_min(xs(ring)), F.array_min(ys(ring)), F.array_max(xs(ring)), F.array_max(ys(ring)))


def box_ring(b: Column) -> Column:
    """The closed ring of a box."""
    return F.array(point(b["xmax"], b["ymin"]), point(b["xmax"], b["ymax"]), point(b["xmin"], b["ymax"]), point(b["xmin"], b["ymin"]), point(b["xmax"], b["ymin"]))


def pixel_index(b: Column, t: Column) -> Column:
    """[col_min, row_min, col_max, row_max] of a map box: corner (xmin, ymin), then (xmax, ymax), rows not sorted again."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    col = lambda x, y: F.floor((t["e"] * (x - t["c"]) - t["b"] * (y - t["f"])) / det)
    row = lambda x, y: F.floor((t["a"] * (y - t["f"]) - t["d"] * (x - t["c"])) / det)
    return F.array(col(b["xmin"], b["ymin"]), row(b["xmin"], b["ymin"]), col(b["xmax"], b["ymax"]), row(b["xmax"], b["ymax"]))


def pixel_box_ring(b: Column, t: Column) -> Column:
    """The map ring of a pixel box [col_min, row_min, col_max, row_max], through pixel centres, rows first."""
    at = lambda col, row: point(t["a"] * (col + 0.5) + t["b"] * (row + 0.5) + t["c"], t["d"] * (col + 0.5) + t["e"] * (row + 0.5) + t["f"])
    x0, y0, x1, y1 = b[0], b[1], b[2], b[3]
    return F.array(at(x0, y0), at(x0, y1), at(x1, y1), at(x1, y0), at(x0, y0))


def edges(ring: Column) -> Column:
    """Pairs of following vertices (p, q) of a ring, closed if it is open."""
    c = close_ring(ring)
    n = F.size(c)
    return F.zip_with(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _cross_sum(ring: Column, factor) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + factor(e) * (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]))


def area(ring: Column) -> Column:
    return F.abs(_cross_sum(ring, lambda e: F.lit(0.5)))


def centroid(ring: Column) -> Column:
    """The centroid by area; of rings without area the mean of the vertices."""
    twice = _cross_sum(ring, lambda e: F.lit(1.0))
    mean = lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v).cast("double"))
    cx = F.try_divide(_cross_sum(ring, lambda e: e["p"]["x"] + e["q"]["x"]), 3 * twice)
    cy = F.try_divide(_cross_sum(ring, lambda e: e["p"]["y"] + e["q"]["y"]), 3 * twice)
    return point(F.coalesce(cx, mean(xs(ring))), F.coalesce(cy, mean(ys(ring))))


def diameter(area_: Column) -> Column:
    """Diameter of the circle of that area."""
    return 2 * F.sqrt(area_ / F.pi())


def densify(ring: Column, spacing: float) -> Column:
    """Vertices added evenly on each edge, so that none is longer than spacing (to nine digits of a spacing); the ring is closed."""

    def on_edge(e):
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        n = F.greatest(F.ceil(F.round(F.hypot(dx, dy) / spacing, 9)), F.lit(1))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: point(e["p"]["x"] + dx * i / n, e["p"]["y"] + dy * i / n))

    return F.concat(F.flatten(F.transform(edges(ring), on_edge)), F.slice(ring, 1, 1))


def largest_part(rings: Column) -> Column:
    """Of the rings of a multipolygon the one of the largest area, the first of equals; null without rings."""
    best = F.array_max(F.transform(rings, lambda r, i: F.struct(area(r).alias("a"), (-i).alias("i"), r.alias("ring"))))
    return best["ring"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with continuous edges."""
    w = F.greatest(F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]), F.lit(0.0))
    h = F.greatest(F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]), F.lit(0.0))
    of = lambda r: (r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"])
    return F.coalesce(F.try_divide(w * h, of(a) + of(b) - w * h), F.lit(0.0))


def right_of(p: Column, e: Column) -> Column:
    """The edge (p, q) crosses the height of a point to its right; of an edge's ends the lower one belongs to it."""
    return ((e["p"]["y"] > p["y"]) != (e["q"]["y"] > p["y"])) & (p["x"] < (e["q"]["x"] - e["p"]["x"]) * F.try_divide(p["y"] - e["p"]["y"], e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])


def on_edge(p: Column, e: Column) -> Column:
    """The point lies on the edge (p, q), its ends included."""
    between = lambda c: p[c].between(F.least(e["p"][c], e["q"][c]), F.greatest(e["p"][c], e["q"][c]))
    return between("x") & between("y") & ((e["q"]["x"] - e["p"]["x"]) * (p["y"] - e["p"]["y"]) == (e["q"]["y"] - e["p"]["y"]) * (p["x"] - e["p"]["x"]))


def contains(ring: Column, p: Column) -> Column:
    """Even-odd test of a point against a ring."""
    return F.size(F.filter(edges(ring), lambda e: right_of(p, e))) % 2 == 1


def _to_segment(p: Column, e: Column) -> Column:
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    t = F.coalesce(F.try_divide((p["x"] - e["p"]["x"]) * dx + (p["y"] - e["p"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(p["x"] - e["p"]["x"] - t * dx, p["y"] - e["p"]["y"] - t * dy)


def segment_distance(a: Column, b: Column) -> Column:
    """Distance of two segments (p, q); 0 where they cross."""
    side = lambda e, v: (e["q"]["x"] - e["p"]["x"]) * (v["y"] - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (v["x"] - e["p"]["x"])
    crosses = (side(a, b["p"]) * side(a, b["q"]) < 0) & (side(b, a["p"]) * side(b, a["q"]) < 0)
    return F.when(crosses, 0.0).otherwise(F.least(_to_segment(a["p"], b), _to_segment(a["q"], b), _to_segment(b["p"], a), _to_segment(b["q"], a)))
