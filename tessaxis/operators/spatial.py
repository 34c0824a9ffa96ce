"""Spatial joins by grid cells: each side is exploded to the cells it covers, joined on the cell, then tested exactly.

A pair of boxes is made once: in the cell that holds the lower left corner of their intersection. All joins take a key
column besides the boxes, and a scene column that both sides share.

box_pairs() has one grid, for boxes of about one size. sized_pairs() has a grid for each power of two: a box lies in the
few cells of its own size's grid and is looked up in the grids of larger boxes, so that rows stay proportional to the table
whatever the sizes are.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.functions import axial, geometry
from tessaxis.sources.stages import dealt, merged, written


def cells(df: DataFrame, box: Column, cell: float, pad: float = 0.0) -> DataFrame:
    """df exploded to (cx, cy) of the cells that the box, widened by pad, touches."""
    at = lambda v: F.floor(v / cell)
    span = lambda lo, hi: F.explode(F.sequence(at(box[lo] - pad), at(box[hi] + pad)))
    return df.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax"))


def box_pairs(a: DataFrame, b: DataFrame, cell: float, on: list[str], pad: float = 0.0) -> DataFrame:
    """Pairs of rows whose boxes (columns box_a, box_b) meet, borders included, once each; b's boxes are widened by pad."""
    left, right = cells(a, F.col("box_a"), cell), cells(b, F.col("box_b"), cell, pad)
    x, y = F.greatest(F.col("box_a.xmin"), F.col("box_b.xmin") - pad), F.greatest(F.col("box_a.ymin"), F.col("box_b.ymin") - pad)
    meets = (x <= F.least(F.col("box_a.xmax"), F.col("box_b.xmax") + pad)) & (y <= F.least(F.col("box_a.ymax"), F.col("box_b.ymax") + pad))
    here = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
    return left.join(merged(right), [*on, "cx", "cy"]).where(meets & here).drop("cx", "cy")


#: Smaller boxes, points too, count as of this power of two.
LEAST_LEVEL = -20


def level(box: Column, pad: float = 0.0) -> Column:
    """The power of two that the longer side of a box, widened by pad, fits in."""
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]) + 2 * pad
    return F.greatest(F.ceil(F.log2(F.when(side > 0, side))), F.lit(LEAST_LEVEL)).cast("int")


def sized_pairs(a: DataFrame, b: DataFrame, on: list[str], pad: float = 0.0) -> DataFrame:
    """As box_pairs(), for boxes of any sizes: each pair is made in the grid of the larger one of its boxes.

    Each row is at most four rows for each level that the other side has, some tens at most for all sizes of doubles. The
    counts of the levels tell how many rows are sorted, so that more rows make more tasks and not larger ones.
    """
    own_a, own_b = a.withColumn("_own", level(F.col("box_a"))), b.withColumn("_own", level(F.col("box_b"), pad))
    found = [dict(sorted(map(tuple, df.groupBy("_own").count().collect()))) for df in (own_a, own_b)]
    levels_a, levels_b = (F.array(*map(F.lit, v)).cast("array<int>") for v in found)
    many = lambda v: sum(n if x == LEAST_LEVEL else 4 * n for x, n in v.items())
    met = lambda small, large, least: sum(many({x: n}) * sum(y >= x + least for y in large) for x, n in small.items())

    def at(df: DataFrame, box: Column, levels: Column, wide: float) -> DataFrame:
        df = df.withColumn("_level", F.explode(levels))
        cell = F.pow(F.lit(2.0), F.col("_level"))
        span = lambda lo, hi: F.explode(F.sequence(F.floor((box[lo] - wide) / cell), F.floor((box[hi] + wide) / cell)))
        return df.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax")).drop("_own")

    def joined(levels_of_a: Column, levels_of_b: Column, rows: int) -> DataFrame:
        left, right = at(own_a, F.col("box_a"), levels_of_a, 0.0), at(own_b, F.col("box_b"), levels_of_b, pad)
        x, y = F.greatest(F.col("box_a.xmin"), F.col("box_b.xmin") - pad), F.greatest(F.col("box_a.ymin"), F.col("box_b.ymin") - pad)
        meets = (x <= F.least(F.col("box_a.xmax"), F.col("box_b.xmax") + pad)) & (y <= F.least(F.col("box_a.ymax"), F.col("box_b.ymax") + pad))
        cell = F.pow(F.lit(2.0), F.col("_level"))
        here = (F.floor(x / cell) == F.col("cx")) & (F.floor(y / cell) == F.col("cy"))
        key = [*on, "_level", "cx", "cy"]
        return dealt(left, rows, *key).join(merged(dealt(right, rows, *key)), key).where(meets & here).drop("_level", "cx", "cy")

    alone = F.array("_own")
    in_a = joined(alone, F.filter(levels_a, lambda v: v >= F.col("_own")), many(found[0]) + met(found[1], found[0], 0))
    if not all(found) or max(found[1]) <= min(found[0]):  # as with points: no b is larger than an a
        return in_a
    return in_a.unionByName(joined(F.filter(levels_b, lambda v: v > F.col("_own")), alone, many(found[1]) + met(found[0], found[1], 1)))


def near_boundary(dets: DataFrame, footprints: DataFrame, distance: Column, cell: float, key: str = "det_id") -> DataFrame:
    """dets with is_at_edge: the ring `geometry` comes within a distance of the boundary of its scene's footprint.

    footprints: scene_id, footprint (ring) and what `distance` needs. A semi-join: each detection stays one row. An edge
    of a footprint is a row only in the cells along it, so a slanting one has rows by its length, not by its box.
    """
    rims = footprints.select("scene_id", distance.alias("_d"), F.explode(geometry.edges(F.col("footprint"))).alias("_rim"))
    p, q, d = F.col("_rim.p"), F.col("_rim.q"), F.col("_d")
    at = lambda v: F.floor(v / cell)
    rims = rims.withColumn("cx", F.explode(F.sequence(at(F.least(p["x"], q["x"]) - d), at(F.greatest(p["x"], q["x"]) + d))))
    # the part of the edge in a column of cells, widened by the distance
    run = q["x"] - p["x"]
    part = lambda x: F.least(F.greatest(F.try_divide(x - p["x"], run), F.lit(0.0)), F.lit(1.0))
    y = lambda x, end: F.when(run == 0, end).otherwise(p["y"] + part(x) * (q["y"] - p["y"]))
    y0, y1 = y(F.col("cx") * cell - d, p["y"]), y((F.col("cx") + 1) * cell + d, q["y"])
    slack = 1e-9 * (F.abs(y0) + F.abs(y1) + d)
    rims = rims.withColumn("cy", F.explode(F.sequence(at(F.least(y0, y1) - d - slack), at(F.greatest(y0, y1) + d + slack))))
    own = dets.select("scene_id", F.col(key), F.col("geometry").alias("_ring"), geometry.bounds(F.col("geometry")).alias("box_a"))
    close = F.exists(geometry.edges(F.col("_ring")), lambda e: geometry.segment_distance(e, F.col("_rim")) <= F.col("_d"))
    hit = cells(own, F.col("box_a"), cell).join(merged(rims), ["scene_id", "cx", "cy"]).where(close).select("scene_id", key).distinct().withColumn("is_at_edge", F.lit(True))
    return dets.join(merged(hit), ["scene_id", key], "left").withColumn("is_at_edge", F.coalesce("is_at_edge", F.lit(False)))


#: Edges in a cell of a region's cover that need no finer cells, and halvings below the wanted size for others.
FEW_EDGES, FINER = 4, 6


def region_cells(ring: np.ndarray, cell: float) -> list[tuple[int, int, int, bool]]:
    """Cells of power-of-two sides that cover a ring (closed, vertices by rows) without overlap: level, cx, cy, whether all of it is inside.

    Cells without an edge are inside or left out; those with edges are halved down to the wanted size, with many edges
    further. So there are as many as the boundary is long, not as the area is large.
    """
    p, q = ring[:-1], ring[1:]
    low, high = ring.min(0), ring.max(0)
    top = int(np.ceil(np.log2(max((high - low).max(), cell, 1e-6))))
    least, found = int(np.floor(np.log2(cell))), []
    first, last = np.floor(low / 2.0**top).astype(int), np.floor(high / 2.0**top).astype(int)
    todo = [(top, x, y, np.arange(len(p))) for x in range(first[0], last[0] + 1) for y in range(first[1], last[1] + 1)]
    while todo:
        level, x, y, near = todo.pop()
        side = 2.0**level
        middle, half = np.array([x + 0.5, y + 0.5]) * side, side / 2 * (1 + 1e-9) + 1e-12 * (abs(x) + abs(y) + 1) * side
        a, b = p[near] - middle, q[near] - middle
        normal = np.column_stack([b[:, 1] - a[:, 1], a[:, 0] - b[:, 0]])
        touches = (np.minimum(a, b) <= half).all(1) & (np.maximum(a, b) >= -half).all(1) & (np.abs((normal * a).sum(1)) <= np.abs(normal).sum(1) * half)
        near = near[touches]
        if not len(near):
            up = (p[:, 1] > middle[1]) != (q[:, 1] > middle[1])
            cross = (q[up, 0] - p[up, 0]) * (middle[1] - p[up, 1]) / (q[up, 1] - p[up, 1]) + p[up, 0]
            if (middle[0] < cross).sum() % 2:
                found.append((level, x, y, True))
        elif level <= least and (len(near) <= FEW_EDGES or level <= least - FINER):
            found.append((level, x, y, False))
        else:
            todo += [(level - 1, 2 * x + i, 2 * y + j, near) for i in (0, 1) for j in (0, 1)]
    return found


def inside_regions(dets: DataFrame, regions: DataFrame, cell: float, key: str = "det_id", strict: bool = False) -> DataFrame:
    """The rows whose centroid (column center) lies in one of the regions (scene_id, ring): a left semi join.

    A region is covered by cells: centroids in its inner cells need no test; for those in border cells the edges at their
    height are counted, each edge being a row at its own height's grid. No row carries a ring. By the even-odd rule a
    part of the boundary is inside; strict: none of it, as with "within".
    """
    regions = written(regions.where(F.size("ring") > 0).select("scene_id", geometry.close_ring(F.col("ring")).alias("ring"), F.monotonically_increasing_id().alias("_region")))
    kind = regions.schema["scene_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, ring in enumerate(batch.column("ring")):
                points = ring.values
                xy = np.column_stack([points.field("x").to_numpy(zero_copy_only=False), points.field("y").to_numpy(zero_copy_only=False)])
                rows = region_cells(xy, cell) if np.isfinite(xy).all() else []
                columns = list(zip(*rows, strict=True)) or [()] * 4
                same = lambda c: batch.column(c).take(pa.array([i] * len(rows), pa.int64()))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same("scene_id"), same("_region"), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:3]), pa.array(columns[3], pa.bool_())], ["scene_id", "_region", "_level", "cx", "cy", "inner"])

    cover = written(regions.mapInArrow(run, f"scene_id {kind}, _region long, _level int, cx long, cy long, inner boolean"))
    of = lambda df: F.array(*(F.lit(r[0]) for r in df.select("_level").distinct().orderBy("_level").collect())).cast("array<int>")
    at = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("_level")))
    own = dets.select("scene_id", key, "center").where("center IS NOT NULL").withColumn("_level", F.explode(of(cover)))
    met = own.withColumn("cx", at(F.col("center.x"))).withColumn("cy", at(F.col("center.y"))).join(merged(cover), ["scene_id", "_level", "cx", "cy"]).drop("_level", "cx", "cy")
    e = F.col("e")
    height = F.abs(e["p"]["y"] - e["q"]["y"])
    edges = regions.select("scene_id", "_region", F.explode(geometry.edges(F.col("ring"))).alias("e"))
    edges = edges.withColumn("_level", F.greatest(F.ceil(F.log2(F.when(height > 0, height))), F.lit(LEAST_LEVEL)).cast("int"))
    edges = edges.withColumn("cy", F.explode(F.sequence(at(F.least(e["p"]["y"], e["q"]["y"])), at(F.greatest(e["p"]["y"], e["q"]["y"])))))
    border = met.where("NOT inner").withColumn("_level", F.explode(of(edges))).withColumn("cy", at(F.col("center.y")))
    right, on = geometry.right_of(F.col("center"), e), geometry.on_edge(F.col("center"), e) if strict else F.lit(False)
    crossed = border.join(merged(edges), ["scene_id", "_region", "_level", "cy"]).where(right | on)
    odd = crossed.groupBy("scene_id", key, "_region").agg(F.count_if(right).alias("c"), F.bool_or(on).alias("on")).where("c % 2 = 1 AND NOT on")
    hit = met.where("inner").select("scene_id", key).unionByName(odd.select("scene_id", key)).distinct()
    return dets.join(merged(hit), ["scene_id", key], "left_semi")


def without_objects(windows: DataFrame, objects: DataFrame, cell: float, key: str = "try_id") -> DataFrame:
    """The windows (scene_id, box) that no object (scene_id, bbox) overlaps; touching borders are no overlap."""
    own = windows.select("scene_id", key, F.col("box").alias("box_a"))
    other = objects.select("scene_id", F.col("bbox").alias("box_b"))
    a, b = F.col("box_a"), F.col("box_b")
    strict = (b["xmin"] < a["xmax"]) & (b["xmax"] > a["xmin"]) & (b["ymin"] < a["ymax"]) & (b["ymax"] > a["ymin"])
    hit = box_pairs(own, other, cell, ["scene_id"]).where(strict).select("scene_id", key).distinct()
    return windows.join(merged(hit), ["scene_id", key], "left_anti")


def point_pairs(a: DataFrame, b: DataFrame, radius: float, on: list[str]) -> DataFrame:
    """Pairs of points (x_a, y_a) and (x_b, y_b) up to radius apart, with dist: b goes to the nine cells around its own."""
    at = lambda c: F.floor(F.col(c) / radius)
    left = a.withColumns({"cx": at("x_a"), "cy": at("y_a")})
    around = F.array(*(F.lit(i).cast("long") for i in (-1, 0, 1)))
    right = b.withColumn("cx", F.explode(F.transform(around, lambda i: at("x_b") + i))).withColumn("cy", F.explode(F.transform(around, lambda i: at("y_b") + i)))
    dist = F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))
    return left.join(merged(right), [*on, "cx", "cy"]).drop("cx", "cy").withColumn("dist", dist).where(F.col("dist") <= radius)


def nearest_matches(refs: DataFrame, models: DataFrame, min_radius: float = 1.0, on: list[str] = ("scene_id",)) -> DataFrame:
    """Each reference with its nearest model row, if that is within max(half its diameter, min_radius).

    Both sides: id, x, y, area and the scene. Each reference looks in the grid of its own radius, so a large one makes no
    more pairs for the small ones. Ties go to the lower id. Several references may share one model row.
    """
    on = list(on)
    dia = geometry.diameter(F.col("ref_area"))
    r = F.greatest(dia / 2, F.lit(min_radius))
    at = lambda d: geometry.box(F.col("x_a") - d, F.col("y_a") - d, F.col("x_a") + d, F.col("y_a") + d)
    a = refs.select(*on, F.col("id").alias("ref_id"), F.col("x").alias("x_a"), F.col("y").alias("y_a"), F.col("area").alias("ref_area")).withColumn("box_a", at(r))
    b = models.select(*on, F.col("id").alias("model_id"), F.col("area").alias("model_area"), geometry.box(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("box_b"))
    best = F.min(F.struct("dist", "model_id", "model_area")).alias("m")
    near = sized_pairs(a, b, on).withColumn("dist", F.hypot(F.col("x_a") - F.col("box_b.xmin"), F.col("y_a") - F.col("box_b.ymin"))).where(F.col("dist") <= r)
    found = near.groupBy(*on, "ref_id", "ref_area").agg(best)
    return found.select(*on, "ref_id", "m.model_id", "m.dist", "ref_area", "m.model_area", (F.col("m.model_area") / F.col("ref_area")).alias("ratio"), dia.alias("ref_dia"))


def unmatched(models: DataFrame, refs: DataFrame, min_radius: float = 1.0, on: list[str] = ("scene_id",)) -> DataFrame:
    """Model rows with no reference within max(half their own diameter, min_radius): over-detections."""
    on = list(on)
    hit = nearest_matches(models, refs, min_radius, on=on).select(*on, F.col("ref_id").alias("id"))
    rows = models.count()
    return dealt(models, rows, *on, "id").join(merged(dealt(hit, rows, *on, "id")), [*on, "id"], "left_anti")


#: Shares of the values on both sides of the median that a digest of DIGEST counts surely brackets it by.
ABOUT, DIGEST = 5e-4, 10_000


def median(values: DataFrame, column: str) -> float | None:
    """The median of a column of a written table, as percentile() has it; null without values. One task gets what lies about it, not all."""
    bracket = values.agg(F.percentile_approx(column, F.array(F.lit(0.5 - ABOUT), F.lit(0.5 + ABOUT)), DIGEST)).first()[0]
    if bracket is None:
        return None
    v, (low, high) = F.col(column), map(F.lit, bracket)
    n, below, inside = values.agg(F.count(v), F.count_if(v < low), F.count_if(v.between(low, high))).first()
    share = ((n - 1) / 2 - below) / max(inside - 1, 1)
    if not 0 <= share <= 1:  # no bracket
        return values.agg(F.percentile(column, 0.5)).first()[0]
    return values.where(v.between(low, high)).agg(F.percentile(column, share)).first()[0]


def match_statistics(refs: DataFrame, models: DataFrame, min_radius: float = 1.0, on: list[str] = ("scene_id",)) -> DataFrame:
    """One row: n_ref, n_model, n_matched, recall, median_ratio, over_detection_frac."""
    matched = written(nearest_matches(refs, models, min_radius, on=on).select("ratio"))
    # rows of a union, not cross joins: nothing is sent to all tasks; the two joins are queries of their own
    counted = {"n_ref": refs, "n_model": models, "n_matched": matched, "n_over": unmatched(models, refs, min_radius, on)}
    each = [df.agg(*((F.count("*") if x == name else F.lit(None).cast("long")).alias(x) for x in counted)) for name, df in counted.items()]
    counts = reduce(DataFrame.union, each).agg(*(F.max(name).alias(name) for name in counted))
    return counts.select("n_ref", "n_model", "n_matched", F.try_divide("n_matched", "n_ref").alias("recall"), F.lit(median(matched, "ratio")).cast("double").alias("median_ratio"), F.try_divide("n_over", "n_model").alias("over_detection_frac"))


#: Bits of a place inside a cell of the largest distance, along each axis, that order points along a curve.
CURVE_BITS = 24


def _curve(x: Column, y: Column, side: float) -> list[Column]:
    """Sort keys along a Z-order curve: the cell of the given side, then the interleaved bits of the place in it."""

    def spread(v: Column) -> Column:
        at = F.least(F.floor((v / side - F.floor(v / side)) * 2**CURVE_BITS), F.lit(2**CURVE_BITS - 1))
        for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            at = at.bitwiseOR(F.shiftleft(at, shift)).bitwiseAND(F.lit(keep))
        return at

    return [F.floor(x / side).alias("_cx"), F.floor(y / side).alias("_cy"), spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).alias("_z")]


def reach(places: DataFrame, k: int, dmax: float, on: list[str]) -> DataFrame:
    """Distinct places (on, x, y) with r: dmax, or a smaller radius that surely holds k other places.

    Places are sorted along a curve over all tasks; the k before and the k after one in its batch give the bound.
    """
    keyed = places.select(*on, "x", "y", *_curve(F.col("x"), F.col("y"), dmax))
    order = [*on, "_cx", "_cy", "_z", "x", "y"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            # rows of one scene are neighbours in the order; so are those of a cell
            new = np.zeros(n, bool)
            for c in on:
                codes = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            group = np.cumsum(new)
            dist = np.full((2 * k, n), np.inf)
            for j in range(1, min(k, n - 1) + 1):
                d = np.where(group[j:] == group[:-j], np.hypot(x[j:] - x[:-j], y[j:] - y[:-j]), np.inf)
                dist[2 * j - 2, j:], dist[2 * j - 1, : n - j] = d, d
            r = np.minimum(np.partition(dist, k - 1, axis=0)[k - 1] * (1 + 1e-9), dmax)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*on, "x", "y")), pa.array(r)], [*on, "x", "y", "r"])

    schema = T.StructType([f for f in placed.schema.fields if f.name in (*on, "x", "y")]).add("r", "double")
    return placed.drop("_cx", "_cy").mapInArrow(run, schema)


def neighbours(points: DataFrame, k: int, dmin: float, dmax: float, on: list[str] = ("scene_id",)) -> DataFrame:
    """The k nearest other points of each (id, x, y) up to dmax away, ranked before those nearer than dmin are left out.

    Exact, at any density: each distinct place first learns a radius that holds k others, then meets the places in that
    radius in the grid of its size, so a crowded part of the plane makes pairs by k, not by its square. A place offers its
    k + 1 lowest ids, however many points lie there. Ties go to the lower id; points without a finite place or a scene have
    no neighbours. Columns: on, id, nbr, dist, azimuth.
    """
    on = list(on)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    known = points.select(*on, "id", F.col("x").cast("double"), F.col("y").cast("double")).where(finite("x") & finite("y")).dropna(subset=on)
    known = known.withColumns({"x": F.col("x") + 0.0, "y": F.col("y") + 0.0})  # one zero
    here = Window.partitionBy(*on, "x", "y").orderBy("id")
    offered = written(known.withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= k + 1))
    asking = written(reach(offered.where("_n = 1"), k, dmax, on))
    at = lambda d: geometry.box(F.col("x") - d, F.col("y") - d, F.col("x") + d, F.col("y") + d)
    a = asking.select(*on, F.col("x").alias("x_a"), F.col("y").alias("y_a"), F.col("r").alias("_r"), at(F.col("r")).alias("box_a"))
    b = offered.select(*on, F.col("id").alias("nbr"), F.col("x").alias("x_b"), F.col("y").alias("y_b"), at(F.lit(0.0)).alias("box_b"))
    near = sized_pairs(a, b, on).withColumn("dist", F.hypot(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b"))).where("dist <= _r")
    nearest = Window.partitionBy(*on, "x_a", "y_a").orderBy("dist", "nbr")
    first = near.withColumn("_rank", F.row_number().over(nearest)).where(F.col("_rank") <= k + 1)
    azimuth = axial.azimuth(F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a"))
    listed = first.groupBy(*on, F.col("x_a").alias("x"), F.col("y_a").alias("y")).agg(F.array_sort(F.collect_list(F.struct("dist", "nbr", azimuth.alias("azimuth")))).alias("_found"))
    # a point's own id is left out of its place's list before the first k are taken
    found = known.join(merged(listed), [*on, "x", "y"]).select(*on, "id", F.explode(F.slice(F.filter("_found", lambda v: v["nbr"] != F.col("id")), 1, k)).alias("_f"))
    return found.select(*on, "id", "_f.nbr", "_f.dist", "_f.azimuth").where(F.col("dist") >= dmin)


def direction_histogram(azimuths: DataFrame, bin_deg: int = 10, by: list[str] = ("window_id",)) -> DataFrame:
    """Percent of azimuths in each bin of each window: by, bin, center_deg, percent; empty bins are 0."""
    by, n = list(by), 180 // bin_deg
    counts = azimuths.groupBy(*by, F.least(F.floor(F.col("azimuth") / bin_deg), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("c"))
    spine = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    c = F.coalesce("c", F.lit(0))
    total = F.sum(c).over(Window.partitionBy(*by))
    return spine.join(counts, [*by, "bin"], "left").select(*by, "bin", ((F.col("bin") + 0.5) * bin_deg).alias("center_deg"), (100 * c / total).alias("percent"))


def mean_direction_histogram(hist: DataFrame) -> DataFrame:
    """Mean over windows of their percent histograms: bin, center_deg, percent."""
    return hist.groupBy("bin", "center_deg").agg(F.avg("percent").alias("percent"))


def window_peaks(hist: DataFrame, by: list[str] = ("window_id",)) -> DataFrame:
    """Per window the center of the first highest bin."""
    return hist.groupBy(*by).agg(F.max_by("center_deg", F.struct("percent", -F.col("bin"))).alias("peak_deg"))


def dense_windows(windows: DataFrame, dets: DataFrame, min_count: int, n: int, cell: float) -> DataFrame:
    """The first n windows (window_id, scene_id, box) whose box meets min_count detections or more, with those detections."""
    own = windows.select("scene_id", "window_id", F.col("box").alias("box_a"))
    pairs = box_pairs(own, dets.withColumnRenamed("bbox", "box_b"), cell, ["scene_id"]).drop("box_a")
    full = pairs.groupBy("window_id").agg(F.count("*").alias("c")).where(F.col("c") >= min_count).orderBy("window_id").limit(n).select("window_id")
    return pairs.join(F.broadcast(full), "window_id").withColumnRenamed("box_b", "bbox")
