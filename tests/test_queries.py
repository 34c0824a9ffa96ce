"""Registered queries against DuckDB, known answers of the operators on small tables, and properties."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tessaxis.functions import axial, geometry
from tessaxis.operators import coco, datasets, masks, nms, orientation, spatial, sweeps, tiles
from tessaxis.plans import fixtures as fx
from tessaxis.plans import registry
from tessaxis.sources import labels, layers, stages

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
        return None
    v = getattr(v, "item", lambda: v)()
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return round(float(v), 5) + 0.0
    return v


def rows(frame, columns):
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", ["scene_orientation", "sliced_prediction", "predict_scene", "e18_orientation_field", "f7_reject_counts", "gs2_population_sweep"])
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_sweeps_take_all_tiles(spark):
    scene = fx.scenes(spark, SF).first()
    assert registry._windows(spark, SF).count() == (scene["width"] // 32) * (scene["height"] // 32)
    whole = sweeps.detect_orientations(fx.scenes(spark, SF), fx.blocks(spark, SF), fx.BLOCK, 32, sweeps.threshold_measure(140, ["scene_id", "patch_id"])).count()
    assert whole == registry.gs2_population_sweep(spark, SF).where("alpha = 0").first()["n"] == registry.gs8_resolution_sweep(spark, SF).where("factor = 1").first()["n"]


def test_all_objects_block_windows(spark):
    reasons = {(r["x0"], r["y0"]): r["reason"] for r in registry._screened(spark, SF).select("x0", "y0", "reason").collect()}
    boxes = np.array([tuple(r["bbox"]) for r in registry._located(spark, SF).select("bbox").collect()])
    assert len(boxes) == fx.angles(spark, SF).count()
    for (x, y), reason in reasons.items():
        left, top = 1000 + 2 * x, 5000 - 2 * y
        met = ((boxes[:, 0] < left + 32) & (boxes[:, 2] > left) & (boxes[:, 1] < top) & (boxes[:, 3] > top - 32)).any()
        assert (reason == "boulder") == met or met and reason == "valid"
    assert {"boulder", None} <= set(reasons.values())


def test_offsets(spark):
    def of(full, size, overlap):
        return spark.range(1).select(tiles.slice_offsets(F.lit(full), size, overlap).alias("o")).first()["o"]

    assert of(300, 500, 0.2) == [0] and of(1500, 500, 0.0) == [0, 500, 1000] and of(10000, 500, 0.2)[:3] == [0, 400, 800]
    for full in (501, 1000, 1234, 22490):
        o = of(full, 500, 0.2)
        assert o[0] == 0 and o[-1] == full - 500 and all(0 < b - a <= 400 for a, b in zip(o, o[1:], strict=False))


def test_axial_table(spark):
    df = spark.createDataFrame([(10.0,), (170.0,), (0.0,), (135.0,), (200.0,), (None,)], "a double")
    assert [r[0] for r in df.select(axial.distance(F.col("a"), 0)).collect()] == [10, 10, 0, 45, 20, None]


def test_asymmetry(spark):
    df = spark.createDataFrame([(135.0,)] * 300 + [(45.0,)] * 100, "angle180 double")
    assert df.agg(axial.asymmetry(F.col("angle180"))).first()[0] == 3
    assert df.where("angle180 > 90").agg(axial.asymmetry(F.col("angle180"))).first()[0] is None


def test_peak_and_interval(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a % 180),) for a in rng.normal(135, 5, 20000)], "angle180 double").withColumn("g", F.lit(1))
    r = orientation.bootstrap_peaks(df, ["g"], 100).first()
    assert abs(r["peak_deg"] - 135) < 1.5 and r["lo_deg"] <= r["peak_deg"] <= r["hi_deg"] and r["hi_deg"] - r["lo_deg"] < 3
    none = orientation.bootstrap_peaks(df.withColumn("angle180", F.lit(None).cast("double")), ["g"], 10).first()
    assert none["peak_deg"] is None and none["lo_deg"] is None


def test_well_resolved(spark):
    df = spark.createDataFrame([(2.0, 10.0, 10.0), (1.2, 10.0, 20.0), (2.0, 1.0, 30.0), (2.0, 10.0, 40.0), (None, 10.0, 50.0)], "aspect_ra double, diameter_m double, angle180 double")
    assert [r["angle180"] for r in orientation.well_resolved(df, 0.5).collect()] == [10, 40]


def test_nms_like_sequential(spark):
    rng = np.random.default_rng(5)
    boxes = [(i, float(x), float(y), float(rng.integers(5, 30)), float(rng.integers(5, 30)), float(rng.integers(1, 9)) / 10) for i, (x, y) in enumerate(rng.integers(0, 100, (150, 2)))]
    df = spark.createDataFrame(boxes, "det_id long, x double, y double, w double, h double, score double").withColumn("scene_id", F.lit(0)).withColumn("category_id", F.lit(1))
    df = df.withColumn("bbox", geometry.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")))

    def iou(a, b):
        w = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        h = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        return w * h / (a[3] * a[4] + b[3] * b[4] - w * h)

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(b, k) <= 0.2 for k in kept):
            kept.append(b)
    for parts in (1, 8):
        assert {r["det_id"] for r in nms.nms(df.repartition(parts), 0.2, cell=16.0).collect()} == {k[0] for k in kept}
    assert nms.nms(df.where("det_id < 0")).count() == 0


def test_nms_of_long_chains_in_few_rounds(spark, monkeypatch):
    """Chains of boxes that each overlap only their neighbours, scores falling along them: one inside a block, one across blocks."""
    chain = [(i, 0.3 * i, 100.0) for i in range(1000)] + [(2000 + i, 5.0 * i, 700.0) for i in range(400)]
    df = spark.createDataFrame([(i, x, y, 1 - i / 10_000) for i, x, y in chain], "det_id long, x double, y double, score double").withColumn("scene_id", F.lit(0)).withColumn("category_id", F.lit(1))
    df = df.withColumn("bbox", geometry.box(F.col("x"), F.col("y"), F.col("x") + F.when(F.col("det_id") < 2000, 0.5).otherwise(8.0), F.col("y") + 8))
    rounds, real = [], nms._decided
    monkeypatch.setattr(nms, "_decided", lambda e: rounds.append(1) or real(e))
    got = {r["det_id"] for r in nms.nms(df, 0.2).collect()}
    assert got == {i for i, *_ in chain if i % 2 == 0} and len(rounds) <= 5  # the second chain crosses four borders of blocks


def greedy(truth, dets, radius):
    """truth: id, x, y in order; dets: id, x, y."""
    used, out, size = set(), {}, 2 * radius
    cells = {}
    for j, a, b in dets:
        cells.setdefault((a // size, b // size), []).append((j, a, b))
    for i, x, y in truth:
        near = [(math.hypot(x - a, y - b), j) for u in (-1, 0, 1) for v in (-1, 0, 1) for j, a, b in cells.get((x // size + u, y // size + v), []) if j not in used]
        if near and min(near)[0] <= radius:
            used.add(min(near)[1])
            out[i] = min(near)[1]
    return out


def matched(spark, truth, dets, radius, most):
    t = spark.createDataFrame([(0.0, i, float(x), float(y)) for i, x, y in truth], "phi0 double, truth_id long, x double, y double")
    d = spark.createDataFrame([(0.0, i, float(x), float(y), 0.5) for i, x, y in dets], "phi0 double, det_id long, x double, y double, score double")
    return {r["truth_id"]: r["det_id"] for r in sweeps.greedy_matches(t, d, radius, most=most).collect()}


@pytest.mark.parametrize("most", [1, 7, 2000])
def test_greedy_matches(spark, most):
    rng = np.random.default_rng(6)
    t = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 90, (80, 2)))]
    d = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 90, (60, 2)))]
    assert matched(spark, t, d, 7.0, most) == greedy(t, d, 7.0)
    assert matched(spark, t, [], 7.0, most) == {}


def test_greedy_matches_of_one_large_component(spark, monkeypatch):
    """A chain of 10^5 pairs with truths in order along it: rounds are few, as blocks decide chains inside them."""
    n, radius = 20_000, 4.0
    t = [(i, 1.5 * i, 0) for i in range(n)]
    d = [(i, 1.5 * i + 1 + i % 2, i % 3 / 4) for i in range(n)]
    rounds, real = [], sweeps._decided
    monkeypatch.setattr(sweeps, "_decided", lambda *a: rounds.append(1) or real(*a))
    assert matched(spark, t, d, radius, 4000) == greedy(t, d, radius)
    assert len(rounds) <= 8


def brute_precision(gt, dets, overlap):
    """COCO scoring, one image, class and threshold after the other. gt: image, id, class, crowd; dets: image, id, class, score; overlap(det, gt, crowd)."""
    by_threshold = {}
    for c in sorted({g[2] for g in gt if not g[3]}):
        for t in coco.THRESHOLDS:
            marks = []
            for image in {d[0] for d in dets}:
                own = sorted((d for d in dets if d[0] == image and d[2] == c), key=lambda d: (-d[3], d[1]))[: coco.MOST_PER_IMAGE]
                used = set()
                for d in own:
                    near = [(overlap(d, g, g[3]), g[1], g[3]) for g in gt if g[0] == image and g[2] == c]
                    free = max(((o, i) for o, i, crowd in near if not crowd and i not in used and o >= t), default=None)
                    if free:
                        used.add(free[1])
                    elif any(crowd and o >= t for o, _, crowd in near):
                        continue
                    marks.append((-d[3], image, d[1], free is not None))
            n, tps, points = sum(g[2] == c and not g[3] for g in gt), 0, []
            for k, (*_, hit) in enumerate(sorted(marks), 1):
                tps += hit
                points.append((tps, tps / k))
            best = [max((p for s, p in points if s * 100 >= j * n), default=0) for j in range(coco.RECALLS)]
            by_threshold.setdefault(t, []).append(sum(best) / coco.RECALLS)
    mean = lambda x: sum(x) / len(x)
    return mean([mean(x) for x in by_threshold.values()]), mean(by_threshold[0.5]), mean(by_threshold[0.75])


@pytest.mark.parametrize("most", [0, coco.RANGES_MOST])
def test_average_precision(spark, monkeypatch, most):
    """Boxes and masks, three classes, crowds (one as large as the image), equal scores, equal truths, a crowded image."""
    monkeypatch.setattr(coco, "RANGES_MOST", most)
    rng = np.random.default_rng(7)
    box = lambda: (x := int(rng.integers(0, 60)), y := int(rng.integers(0, 60)), x + int(rng.integers(3, 14)), y + int(rng.integers(3, 14)))
    gt = [(i % 4, i, i % 3, int(i % 11 == 5), box()) for i in range(90)] + [(1, 500, 2, 1, (0, 0, 80, 80)), (9, 501, 0, 0, box()), (2, 502, 1, 0, (5, 5, 15, 15)), (2, 503, 1, 0, (5, 5, 15, 15))]
    moved = lambda b, k: tuple(v + k * s for v, s in zip(b, (1, 0, 1, 1), strict=True))
    dets = [(g[0], 10 * j + k, g[2] if j % 7 else (g[2] + 1) % 4, float(rng.integers(0, 20)) / 20, moved(g[4], k)) for j, g in enumerate(gt) for k in range(int(rng.integers(0, 3)))]
    dets += [(3, 5000 + i, 0, 0.05 + i % 50 / 100, box()) for i in range(150)]
    g = spark.createDataFrame([(a, b, c, d, tuple(map(float, e))) for a, b, c, d, e in gt], "image_id long, inst_id long, label int, iscrowd int, box struct<x1:double,y1:double,x2:double,y2:double>")
    d = spark.createDataFrame([(a, b, c, s, tuple(map(float, e))) for a, b, c, s, e in dets], f"image_id long, det_id long, category_id int, score double, box {geometry.BOX}")
    dets = [x for x in dets if x[3] >= 0.05]
    truth, found = coco.ground_truth(g), coco.predictions(d.repartition(5))

    def box_overlap(a, b, crowd):
        a, b = a[4], b[4]
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        of = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return i / (of(a) if crowd else of(a) + of(b) - i)

    got = tuple(coco.average_precision(truth, found, coco.box_overlaps(truth, found)).first())
    assert got == pytest.approx(brute_precision(gt, dets, box_overlap)) and 0 < got[2] < got[1] < 1

    # masks: the boxes' pixels without a hole in the middle and the last corner
    def px(b):
        mx, my = (b[0] + b[2]) // 2, (b[1] + b[3]) // 2
        return {(r, c) for r in range(b[1], b[3]) for c in range(b[0], b[2])} - {(my, mx), (b[3] - 1, b[2] - 1)}

    def mask_overlap(a, b, crowd):
        a, b = px(a[4]), px(b[4])
        return len(a & b) / len(a if crowd else a | b)

    pixels = lambda rows, key: coco.column_runs(spark.createDataFrame([(x[0], x[2], x[1], r, c) for x in rows for r, c in px(x[4])], f"image_id long, category_id int, {key} long, row int, col int"), "image_id", "category_id", key)
    kept = {(r["image_id"], r["det_id"]) for r in found.collect()}
    masks_ = coco.mask_overlaps(truth, found, pixels(gt, "gt_id"), pixels([x for x in dets if (x[0], x[1]) in kept], "det_id"))
    assert tuple(coco.average_precision(truth, found, masks_).first()) == pytest.approx(brute_precision(gt, dets, mask_overlap))
    none = coco.average_precision(truth, found.limit(0), coco.box_overlaps(truth, found.limit(0))).first()
    assert tuple(none) == (0, 0, 0)


def test_pairs_of_any_sizes(spark):
    rng = np.random.default_rng(8)
    sides = [0.0, 0.3, 1.0, 2.0, 8.0, 700.0]
    rows = [(i, float(x), float(y), float(rng.choice(sides)), float(rng.choice(sides))) for i, (x, y) in enumerate(rng.uniform(-50, 1000, (300, 2)))]
    df = spark.createDataFrame(rows, "id long, x double, y double, w double, h double").withColumn("s", F.lit(1))
    side = lambda t: df.select("s", F.col("id").alias(f"id_{t}"), geometry.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias(f"box_{t}"))
    for pad in (0.0, 5.0):
        got = sorted((r["id_a"], r["id_b"]) for r in spatial.sized_pairs(side("a"), side("b"), ["s"], pad).collect())
        meet = lambda a, b, i, n: a[i] <= b[i] + b[n] + pad and b[i] - pad <= a[i] + a[n]  # noqa: B023, E731
        assert got == sorted((a[0], b[0]) for a in rows for b in rows if meet(a, b, 1, 3) and meet(a, b, 2, 4))


def test_one_large_object_makes_no_more_pairs_of_small_ones(spark):
    n = 3000
    at = lambda k: ((k * 7919) % 10007 / 10.0, (k * 6007) % 10009 / 10.0)
    small = [(i, *at(i), 3.0) for i in range(n)]
    models = spark.createDataFrame([(i, x + 0.5, y, a) for i, x, y, a in small], "id long, x double, y double, area double").withColumn("scene_id", F.lit(0))

    def pairs(refs):
        made = spatial.nearest_matches(spark.createDataFrame(refs, "id long, x double, y double, area double").withColumn("scene_id", F.lit(0)), models)
        made.collect()
        plan = made._jdf.queryExecution().executedPlan()
        plan = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan
        counts, todo = [], [plan]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if "Join" in name and node.metrics().contains("numOutputRows"):
                counts.append(node.metrics().apply("numOutputRows").value())
            if name in ("ShuffleQueryStage", "BroadcastQueryStage"):
                todo.append(node.plan())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return made.count(), sum(counts)

    (matched, alone), (more, both) = pairs(small), pairs([*small, (n, 500.0, 500.0, 10.0**6 * math.pi)])
    assert matched <= more <= matched + 1 and both - alone <= 2 * n  # the large one meets each model once


def star(n, x, y, r):
    """A ring with n points, every second one nearer the middle."""
    return [(x + (r if i % 2 else r / 2.5) * math.cos(2 * math.pi * i / n), y + (r if i % 2 else r / 2.5) * math.sin(2 * math.pi * i / n)) for i in range(n)]


def test_inside_regions_like_the_even_odd_rule(spark):
    rng = np.random.default_rng(9)
    rings = [star(41, 500, 500, 480), star(6, 100, 900, 30), [(0, 0), (50, 0), (50, 50), (0, 50), (0, 0)], [(10, 700), (30, 720), (10, 720), (30, 700)], star(3001, 700, 200, 150), [(5, 5), (9, 9)], []]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(-20, 1020, (1500, 2)), rng.integers(0, 60, (200, 2)), rings[0][:20]]))]

    def inside(x, y, ring):
        odd = False
        for (a, b), (c, d) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            odd ^= (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a
        return odd

    d = spark.createDataFrame([(s, i, (x, y)) for s in (0, 1) for i, x, y in points] + [(0, -1, None)], f"scene_id long, det_id long, center {geometry.POINT}")
    r = spark.createDataFrame([(0, [tuple(map(float, v)) for v in ring]) for ring in rings] + [(1, [tuple(map(float, v)) for v in rings[2]])], f"scene_id long, ring {geometry.RING}")
    for cell in (4.0, 64.0):
        got = {(x["scene_id"], x["det_id"]) for x in spatial.inside_regions(d, r, cell).collect()}
        assert got == {(0, i) for i, x, y in points if any(inside(x, y, ring) for ring in rings if ring)} | {(1, i) for i, x, y in points if inside(x, y, rings[2])}


def test_cover_grows_with_the_boundary():
    ring = lambda r: np.array([*star(40, 0.3, 0.7, r), star(40, 0.3, 0.7, r)[0]])
    small, large = (len(spatial.region_cells(ring(r), 8.0)) for r in (500.0, 4000.0))
    assert small < large < 12 * small  # eight times the boundary, 64 times the area
    assert sum(4.0**k for k, *_, inner in spatial.region_cells(ring(500.0), 8.0) if inner) <= 500.0**2 * math.pi


def test_near_slanting_boundary(spark):
    rng = np.random.default_rng(10)
    rim = [(0.0, 0.0), (1000.0, 700.0), (300.0, 1000.0), (-50.0, 400.0), (-50.0, 100.0)]
    boxes = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-100, 1100, (800, 2)))]
    d = spark.createDataFrame(boxes, "det_id long, x double, y double").withColumn("scene_id", F.lit(0)).withColumn("geometry", geometry.box_ring(geometry.box(F.col("x"), F.col("y"), F.col("x") + 6, F.col("y") + 6)))
    f = spark.createDataFrame([(0, rim)], f"scene_id int, footprint {geometry.RING}")
    t = np.linspace(0, 1, 4001)[:, None]
    line = np.vstack([np.array(a) + t * (np.array(b) - np.array(a)) for a, b in zip(rim, [*rim[1:], rim[0]], strict=True)])
    far = lambda x, y: np.hypot(np.maximum(np.maximum(x - line[:, 0], line[:, 0] - x - 6), 0), np.maximum(np.maximum(y - line[:, 1], line[:, 1] - y - 6), 0)).min()
    want = {i: far(x, y) for i, x, y in boxes}
    inside_box = {i for i, v in want.items() if v == 0}
    got = {r["det_id"]: r["is_at_edge"] for r in spatial.near_boundary(d, f, F.lit(12.0), 16.0).collect()}
    assert got.keys() == want.keys() and all(got[i] == (v <= 12) for i, v in want.items() if abs(v - 12) > 0.2 and i not in inside_box)
    assert all(got[i] for i in inside_box)


def test_edges_and_closing(spark):
    ring = lambda pts: F.array(*(geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in pts))
    r = spark.range(1).select(geometry.off_edges(ring([(10, 10), (20, 10), (20, 20)]), 512, 512), geometry.off_edges(ring([(-0.5, 10), (20, 10), (20, 20)]), 512, 512), F.size(geometry.close_ring(ring([(0, 0), (1, 0), (1, 1)]))), geometry.area(ring([(0, 0), (2, 0), (2, 1), (0, 1)]))).first()
    assert tuple(r) == (True, False, 4, 2.0)
    parts = spark.range(1).select(F.size(geometry.largest_part(F.array(ring([(0, 0), (1, 0), (1, 1)]), ring([(0, 0), (5, 0), (5, 5), (0, 5)])))).alias("n"))
    assert parts.first()["n"] == 4


def test_field_of_tiles_is_the_whole_field(spark):
    from tessaxis.functions import images
    from tessaxis.operators import texture

    m = texture.halo(1.0, 2.0)
    blocks = fx.blocks(spark, SF)
    h = fx.scenes(spark, SF).first()["height"]
    whole = np.zeros((h, 128), np.uint8)
    for b in blocks.where(f"block_row < {h // 8}").collect():
        whole[b["block_row"] * 8 : b["block_row"] * 8 + 8, b["block_col"] * 8 : b["block_col"] * 8 + 8] = np.frombuffer(b["pixels"], np.uint8).reshape(8, 8)
    az, coh = images.orientation_field(whole, 1.0, 2.0)
    w = spark.createDataFrame([(0, 1, 40 - m, 48 - m, 16 + 2 * m, 16 + 2 * m)], "scene_id long, tile_id long, x0 int, y0 int, sw int, sh int")
    got = texture.orientation_field(tiles.read_windows(w, blocks, 8), 1.0, 2.0, m).collect()
    assert len(got) == 256 and all(abs(r["coh"] - coh[r["row"], r["col"]]) < 1e-9 for r in got)


def test_label_files_round_trip(spark, tmp_path):
    a = np.zeros((12, 12), int)
    a[2:9, 3:8] = 1
    flat = a.T.ravel()
    runs = np.diff(np.flatnonzero(np.r_[True, flat[1:] != flat[:-1], True]))
    df = spark.createDataFrame([("train", "a.png", [([0.0], ([12, 12], [int(x) for x in runs]))]), ("train", "b.png", [])], f"dataset string, file_name string, annotations {datasets.ANNOTATIONS}")
    df.coalesce(1).write.json(str(tmp_path / "a"))
    lines = datasets.label_lines(labels.read_annotations(spark, str(tmp_path / "a/*.json"), False), 5, 100)
    got = {r["file_stem"]: r["text"] for r in lines.collect()}
    assert got["b"] == "" and got["a"].startswith("0 ") and len(got["a"].split()) == 1 + 2 * 25
    labels.write_label_files(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_split_sources(spark, tmp_path):
    d = tmp_path / "root/train/labels"
    d.mkdir(parents=True)
    (d / "x.txt").write_text("0 0.1 0.1 0.2 0.1 0.2 0.2\n0 0.1 0.2\n")
    (d / "y.txt").write_text("")
    found = labels.read_label_files(spark, str(tmp_path / "root"))
    assert {(r["split"], r["stem"]) for r in found.collect()} == {("train", "x")}  # an empty file is no row, as if it were missing
    images = spark.createDataFrame([("train", p, p, 100, 50) for p in ("x", "y", "z")], "split string, stem string, path string, width int, height int")
    rows_ = datasets.with_labels(datasets.ranked_images(images), found)
    polygons = datasets.parse_label_lines(rows_)
    assert rows_.count() == 3 and polygons.count() == 1 and labels.split_images(images, "test") is None
    with pytest.raises(FileNotFoundError):
        labels.required_images(images, "validation")


def test_flip_is_an_involution(spark):
    df = spark.createDataFrame([(96, (5.0, 5.0, 25.0, 20.0))], "width int, box struct<x1:double,y1:double,x2:double,y2:double>")
    once = datasets.flipped(df)
    assert tuple(once.first()["box"]) == (71.0, 5.0, 91.0, 20.0) and tuple(datasets.flipped(once).first()["box"]) == (5.0, 5.0, 25.0, 20.0)


def test_layers_and_stages(spark, tmp_path):
    assert layers.layer_name("s", 0.29, 512, 1024, 0.2, True, "bbox", True) == "s-predictions-ct-028-ss-512-is-1024-ov-020-downscaled-bbox-nms"
    d = fx.detections(spark, SF).withColumn("polygon", F.col("geometry"))
    layers.write_layers(d, str(tmp_path / "l"))
    layers.write_layers(d, str(tmp_path / "g"), save_boxes=False, output_format="geojson")
    assert spark.read.parquet(str(tmp_path / "l/layer=bbox")).count() == d.count() == spark.read.text(str(tmp_path / "g/layer=mask")).count()
    d.write.parquet(str(tmp_path / "d"))
    assert layers.read_bounds(spark, str(tmp_path / "d")).columns == ["xmin", "ymin", "xmax", "ymax"]
    layers.write_orientations(d, str(tmp_path / "csv"))
    assert "score" in spark.read.option("header", True).csv(str(tmp_path / "csv")).columns
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert stages.stage(spark, str(tmp_path / "st"), build).count() == 3
    assert len(calls) == 1 and stages.stage(spark, str(tmp_path / "st"), build, force=True).count() == 3 and len(calls) == 2


def test_neighbours_of_crowded_points(spark, monkeypatch):
    """Points thinly spread, in two dense clusters and 300 at one place: as brute force, with pairs by k and not by the clusters' squares."""
    rng, k, dmin, dmax = np.random.default_rng(8), 4, 0.02, 40.0
    xy = np.concatenate([rng.uniform(-200, 600, (150, 2)), rng.normal(50, 0.05, (1200, 2)), rng.normal([300, -80], 1.0, (800, 2)), np.full((300, 2), 7.25)])
    scene = np.where(np.arange(len(xy)) % 5 == 0, 1, 0)
    rows = [(int(s), i, float(x), float(y)) for i, (s, (x, y)) in enumerate(zip(scene, xy, strict=True))]
    odd = [(0, 9001, None, 1.0), (0, 9002, float("nan"), 1.0), (None, 9003, 50.0, 50.0), (2, 9004, 50.0, 50.0), (0, 9005, float("inf"), 7.0)]
    df = spark.createDataFrame(rows + odd, "scene_id long, id long, x double, y double").withColumn("dist", F.lit("other"))
    made, real = [], spatial.sized_pairs
    monkeypatch.setattr(spatial, "sized_pairs", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    got = {(r["id"], r["nbr"]): r["dist"] for r in spatial.neighbours(df.repartition(7), k, dmin, dmax).collect()}
    want = {}
    for i in range(len(xy)):
        d = np.where((scene == scene[i]) & (np.arange(len(xy)) != i), np.hypot(*(xy - xy[i]).T), np.inf)
        for j in np.lexsort((np.arange(len(xy)), d))[:k]:
            if dmin <= d[j] <= dmax:
                want[i, int(j)] = d[j]
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert made[0].count() < 12 * k * len(xy)  # all pairs up to dmax would be about a million


def test_steps_on_masks(spark):
    """Steps one by one give what one pass gives; null and broken masks give nulls, rows that fail a test go."""
    rng = np.random.default_rng(6)
    cells = [np.asarray(rng.random((h, w)) < 0.7, np.float32) for h, w in rng.integers(1, 20, (25, 2))]
    rows = [(i, masks.to_mask(a), f"m{i}") for i, a in enumerate(cells)] + [(90, None, None), (91, {"h": 3, "w": 3, "data": b"12"}, "x"), (92, {"h": 0, "w": 0, "data": b""}, "y")]
    df = spark.createDataFrame(rows, f"det_id long, mask {masks.MASK}, area string").drop("area").withColumn("note", F.lit("n"))
    once = masks.apply(df, masks.resizing(8, 8, "nearest"), masks.measuring("sum"), masks.LARGEST, masks.checking(4), masks.CROP, masks.tracing("border"))
    chain = masks.contours(masks.cropped(masks.validity(masks.kept_component(masks.with_area(masks.resized(df, 8, 8, "nearest"), "sum")), 4)), "border")
    order = sorted(once.columns)
    assert once.select(order).orderBy("det_id").collect() == chain.select(order).orderBy("det_id").collect()
    bad = {r["det_id"]: r for r in once.collect() if r["det_id"] >= 90}
    assert all(bad[i]["mask"] is None and bad[i]["area"] is None and bad[i]["polygon"] is None and bad[i]["note"] == "n" for i in (90, 91, 92))
    assert masks.with_area(df).where("det_id = 92").first()["area"] == 0
    kept = masks.apply(df, masks.measuring("nonzero"), masks.keeping(lambda v: v > 40), keep_mask=False)
    assert {r["det_id"]: r["area"] for r in kept.collect()} == {i: a.sum() for i, a in enumerate(cells) if a.sum() > 40}
    px = masks.pixels(df.where("det_id < 91"))
    assert {(r["det_id"], r["row"], r["col"]) for r in px.collect()} == {(i, y, x) for i, a in enumerate(cells) for y, x in zip(*map(list, np.nonzero(a)), strict=True)}


@pytest.mark.parametrize(("size", "overlap", "side"), [(20, 0.2, 24), (20, 0.75, 40), (32, 0.0, 32), (9, 0.5, 8), (64, 0.25, None)])
def test_tiles_by_strips(spark, size, overlap, side):
    """Strips give the pixels that windows one by one give; blocks move by the strips' rims, not by the overlap."""
    scenes, blocks = fx.piece_scenes(spark, SF), fx.piece_blocks(spark, SF).where("block_row <> 3 OR block_col <> 5")
    grid = tiles.tile_grid(scenes, size, overlap)
    want = {(r["scene_id"], r["tile_id"]): bytes(r["pixels"]) for r in tiles.read_windows(grid, blocks, fx.BLOCK).collect()}
    got = tiles.read_grid(grid, blocks, fx.BLOCK, size, side=side).collect()
    assert len(got) == len(want) and {(r["scene_id"], r["tile_id"]): bytes(r["pixels"]) for r in got} == want
    side = side or tiles.strip_side(fx.BLOCK, size, size)
    total = lambda df: df.agg(F.sum(F.length("pixels"))).first()[0]
    assert total(tiles.in_strips(blocks, fx.BLOCK, size, side)) <= (1 + -(-size // fx.BLOCK) * fx.BLOCK / side) ** 2 * total(blocks)


def test_empty_inputs(spark):
    d = fx.detections(spark, SF).limit(0)
    assert masks.georeferenced(d.withColumnRenamed("geometry", "polygon"), fx.scenes(spark, SF)).count() == 0
    assert spatial.neighbours(d.selectExpr("scene_id", "det_id AS id", "bbox.xmin AS x", "bbox.ymin AS y"), 3, 0, 10).count() == 0
    cut = tiles.tiles(fx.scenes(spark, SF), fx.blocks(spark, SF), 8, 32).limit(0)
    assert tiles.detect(cut, tiles.threshold_predictor(1)).count() == 0


def test_scenes_do_not_mix(spark):
    from tessaxis.plans import pipeline

    scenes, blocks = fx.piece_scenes(spark, SF), fx.piece_blocks(spark, SF)
    run = lambda t: pipeline.predict_scene(t, blocks.join(t.select("scene_id"), "scene_id"), fx.BLOCK, tiles.threshold_predictor(138, 8), 32, 0.2, 0.5, 8)[1]
    of = lambda df: sorted((r["scene_id"], r["det_id"], round(r["angle180"], 6), round(r["aspect_ra"], 6)) for r in df.collect())
    some = scenes.where("scene_id < 3")
    assert of(run(some)) == sorted(x for i in range(3) for x in of(run(scenes.where(f"scene_id = {i}"))))
    # the same keys in two scenes: one suppressed in the first, clean in the second
    box = lambda x: (float(x), 0.0, x + 10.0, 10.0)
    rows = [(0, 1, 1, 0.9, box(0)), (0, 2, 1, 0.8, box(1)), (1, 1, 1, 0.9, box(0)), (1, 2, 1, 0.8, box(50))]
    d = spark.createDataFrame(rows, "scene_id long, det_id long, category_id int, score double, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    assert sorted((r["scene_id"], r["det_id"]) for r in nms.nms(d).collect()) == [(0, 1), (1, 1), (1, 2)]
    whole = pipeline.multi_scale({32: d.withColumn("geometry", F.to_json("bbox"))})
    assert whole.count() == 3


def test_mask_needed(spark):
    from tessaxis.plans import pipeline

    with pytest.raises(ValueError):
        pipeline.sliced_prediction(None, None, 8, None, None, has_mask=False)


def test_rejects_have_their_reasons(spark):
    mask = lambda a: (a.shape[0], a.shape[1], bytearray(np.ascontiguousarray(a, np.float32).tobytes()))
    full = np.pad(np.ones((6, 6)), 2)
    rows = [(0, 0, 0, 0.9, 1, 0, 0, mask(full)), (0, 0, 1, 0.9, 2, 0, 0, mask(full)), (0, 0, 2, 0.9, 1, 0, 0, mask(full * 0)), (1, 0, 0, 0.9, 2, 0, 0, mask(full * 0)), (1, 0, 1, 0.9, 1, 0, 0, mask(full * 0.4))]
    raw = spark.createDataFrame(rows, f"scene_id long, tile_id long, local_id long, score double, category_id int, x0 int, y0 int, mask {masks.MASK}")
    names = spark.createDataFrame([(1, "boulder")], "category_id int, category_name string")
    of = lambda **k: sorted(tuple(r) for r in masks.rejects(raw, names, 10, downscale=False, **k).collect())
    assert of() == [(0, "area", 1), (0, "category", 1), (1, "area", 2)]
    assert of(min_area=-1) == [(0, "category", 1), (0, "contour", 1), (1, "contour", 2)]
    assert of(area_rule="nonzero", mask_rule="positive") == [(0, "area", 1), (0, "category", 1), (1, "area", 1)]
    kept = masks.detections(raw, names, 10, downscale=False)
    assert kept.count() + sum(n for *_, n in of()) == len(rows)


def test_detections_in_place_reach_the_border_tiles(spark):
    raster = np.zeros((72, 72), np.uint8)
    raster[50:56, 58:68] = 200  # in the border tile of 32 x 32
    raster[5:12, 10:30] = 200
    blocks = [(0, i, j, 8, 8, bytearray(raster[8 * i : 8 * i + 8, 8 * j : 8 * j + 8].tobytes())) for i in range(9) for j in range(9)]
    b = spark.createDataFrame(blocks, "scene_id long, block_row int, block_col int, h int, w int, pixels binary")
    s = spark.createDataFrame([(0, 72, 72)], "scene_id long, width int, height int")
    found = sweeps.detections_in_place(s, b, 8, 40, sweeps.threshold_measure(140, ["scene_id", "patch_id", "x0", "y0"])).collect()
    assert sorted((round(r["cx_img"]), round(r["cy_img"])) for r in found) == [(20, 8), (62, 52)]


def test_regional_histogram_of_stripes(spark):
    """Crops of stripes at two azimuths weigh alike, whatever their contrast; a crop of zeros does not count."""
    y, x = np.mgrid[:48, :48]
    stripes = lambda t, c: (128 + c * np.sin(2 * np.pi * t / 6)).astype(np.uint8)
    crops = [(1, stripes(x, 20)), (2, stripes(y, 60)), (3, np.zeros((48, 48), np.uint8))]
    df = spark.createDataFrame([(i, 0, 0, 48, 48, bytearray(a.tobytes())) for i, a in crops], "try_id long, x0 int, y0 int, sw int, sh int, pixels binary")
    from tessaxis.operators import texture

    got = texture.regional_histogram(df, [(1.0, 2.0), (2.0, 3.0)]).collect()
    assert len(got) == 36 and all(abs(sum(r["percent"] for r in got if r["scale"] == i) - 100) < 1e-9 for i in (0, 1))
    for i in (0, 1):
        by = {r["bin"]: r["percent"] for r in got if r["scale"] == i}
        assert by[0] + by[17] == pytest.approx(50, abs=1) and by[8] + by[9] == pytest.approx(50, abs=1)


def test_written_restores_settings(spark):
    """While a table is written batches are small; afterwards the session's settings are as they were, set or unset."""
    names = (stages.BATCH, stages.BYTES, stages.CLEANUP)
    before = [spark.conf.get(x, None) for x in names]
    stages.dropped(stages.written(spark.range(3)))
    assert [spark.conf.get(x, None) for x in names] == before
    spark.conf.set(stages.BATCH, "7")
    try:
        stages.dropped(stages.written(spark.range(3)))
        assert spark.conf.get(stages.BATCH) == "7"
    finally:
        spark.conf.unset(stages.BATCH)
