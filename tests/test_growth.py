"""Steps whose cost must not grow faster than the tables: no growing table is sent to all tasks, work is spread, batches are bounded."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessaxis.functions import geometry, images
from tessaxis.operators import coco, masks, orientation, spatial, sweeps, texture, tiles
from tessaxis.plans import fixtures, registry
from tessaxis.sources import stages


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, *names):
    return spark.createDataFrame([(0.0, 1, 1.0, 2.0), (0.0, 2, 3.0, 4.0)], "phi0 double, " + ", ".join(f"{n} {t}" for n, t in zip(names, ("long", "double", "double"), strict=True)))


def test_recall_sweep_sends_no_table_to_all_tasks(spark):
    t, d = points(spark, "truth_id", "x_a", "y_a"), points(spark, "det_id", "x_b", "y_b")
    assert "Broadcast" not in plan(spatial.point_pairs(t, d, 5.0, ["phi0"]))
    pairs = spark.createDataFrame([(0.0, 1, 2, 0.5, 1.0, (0, 0, 0))], "phi0 double, truth_id long, det_id long, score double, dist double, block struct<cx:long,cy:long,chunk:long>")
    decided = sweeps._decided(pairs, "phi0")
    assert "Broadcast" not in plan(decided)
    assert [(r["truth_id"], r["det_id"]) for r in decided.collect()] == [(1, 2)]


def test_mask_overlaps_send_no_table_to_all_tasks(spark):
    gt = spark.createDataFrame([(1, 7, 0, 0)], "image_id long, gt_id long, category_id int, iscrowd int")
    d = spark.createDataFrame([(1, 8, 0, 0.9)], "image_id long, det_id long, category_id int, score double")
    runs = lambda key, i: spark.createDataFrame([(1, 0, i, 3, 0, 9)], f"image_id long, category_id int, {key} long, col long, r0 long, r1 long")
    found = coco.mask_overlaps(gt, d, runs("gt_id", 7), runs("det_id", 8))
    assert "Broadcast" not in plan(found)
    assert [(r["det_id"], r["gt_id"], r["iou"]) for r in found.collect()] == [(8, 7, 1.0)]


def test_matches_send_no_table_to_all_tasks(spark):
    own = spark.createDataFrame([(0, 1, 0.0, 0.0, 9.0), (0, 2, 50.0, 0.0, 9.0)], "scene_id long, id long, x double, y double, area double")
    other = spark.createDataFrame([(0, 5, 0.5, 0.0, 9.0)], "scene_id long, id long, x double, y double, area double")
    assert "Broadcast" not in plan(spatial.nearest_matches(own, other))
    over = spatial.unmatched(own, other)
    assert "Broadcast" not in plan(over)
    assert [r["id"] for r in over.collect()] == [2]


@pytest.mark.parametrize("cell", [4.0, 64.0])
def test_a_boundary_is_not_within_its_region(spark, cell):
    """Sides, corners and a slanting edge; a point on the rim of one region may lie inside another."""
    rings = [[(0, 0), (60.5, 0), (60.5, 90.5), (0, 90.5)], [(100, 0), (140, 40), (100, 80)], [(50, 10), (70, 10), (70, 20), (50, 20)]]
    points = {1: (0, 5), 2: (5, 0), 3: (0, 0), 4: (60.5, 5), 5: (5, 90.5), 6: (1, 1), 7: (120, 20), 8: (119, 20), 9: (100, 40), 10: (60.5, 15), 11: (140, 40), 12: (30, -1)}
    d = spark.createDataFrame([(0, i, (float(x), float(y))) for i, (x, y) in points.items()], f"scene_id long, det_id long, center {geometry.POINT}")
    r = spark.createDataFrame([(0, [tuple(map(float, v)) for v in ring]) for ring in rings], f"scene_id long, ring {geometry.RING}")
    assert {x["det_id"] for x in spatial.inside_regions(d, r, cell, strict=True).collect()} == {6, 8, 10}


def pixel_rows(spark):
    rows = [(i, r, c, 0.5 + (r + c) % 2) for i, (h, w) in enumerate(((3, 9), (8, 2), (5, 4))) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "det_id long, row int, col int, w double")


def test_moments_join_no_table(spark):
    found = orientation.moment_orientations(pixel_rows(spark).withColumn("w", F.lit(2.0)))
    assert "Join" not in plan(found)
    got = {r["det_id"]: (r["angle180"] % 180, r["aspect_ra"]) for r in found.collect()}
    assert set(got) == {0, 1, 2} and got[0][0] == pytest.approx(90) and min(got[1][0], 180 - got[1][0]) == pytest.approx(0, abs=1e-6)


def test_pixels_of_masks_are_counted_after_they_are_dealt_out(spark):
    """No task counts cells before the shuffle, and what is shuffled is not put into few tasks."""
    px = pixel_rows(spark)
    for found in (masks.mask_iou(px, px.withColumn("col", F.col("col") + 1)), masks.block_means(px, 2)):
        text = plan(found)
        assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text
    shifted = masks.mask_iou(px, px.withColumn("col", F.col("col") + 1))
    assert {r["det_id"]: r["iou"] for r in shifted.collect()} == {0: 8 / 10, 1: 1 / 3, 2: 3 / 5}


def test_pixels_without_a_key_or_a_place_match_nothing(spark):
    px = spark.createDataFrame([(1, None, 0), (1, 2, 2), (None, 0, 0)], "det_id long, row int, col int")
    assert {r["det_id"]: r["iou"] for r in masks.mask_iou(px, px).collect()} == {1: 1 / 3, None: 0.0}


def test_rings_are_densified_in_arrays_as_by_columns(spark):
    rings = [[(0, 0), (3, 0), (3, 2.5)], [(0, 0), (1.2, 0), (1, 1), (0, 0)], [], [(5, 5)], [(1, 1), (1, 1)], [(0, 0), (0.9, 0.3), (2, 8), (-3, 4.5), (0, 0)]]
    spacing = [0.7, 0.3, 1.0, 1.0, 1.0, 0.25]
    d = spark.createDataFrame([(i, [tuple(map(float, v)) for v in r], s) for i, (r, s) in enumerate(zip(rings, spacing, strict=True))], f"i int, ring {geometry.RING}, s double")
    wanted = {r["i"]: [tuple(v) for v in r["g"]] for r in d.select("i", geometry.densify(F.col("ring"), F.col("s")).alias("g")).collect()}
    flat = np.array([v for r in rings for v in r], float)
    x, y, n = images.densified(flat[:, 0], flat[:, 1], np.array([len(r) for r in rings]), np.array(spacing))
    got = np.split(np.column_stack([x, y]), np.cumsum(n)[:-1])
    for i, g in enumerate(got):
        assert n[i] == len(wanted[i])
        assert np.allclose(g, np.array(wanted[i]).reshape(-1, 2), atol=1e-12)
    d = d.withColumn("geometry", F.col("ring")).withColumn("s", F.when(F.col("i") < 5, F.col("s")))
    fits = orientation.ellipse_fits(d, spacing=F.col("s"))
    assert "hypot" not in plan(fits).lower()
    assert {r["i"]: r["angle180"] is not None for r in fits.collect()} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}


def test_windows_and_strips_are_not_put_into_few_tasks(spark):
    windows = spark.createDataFrame([(0, 1, 0, 0, 4, 4)], "scene_id long, tile_id long, x0 int, y0 int, sw int, sh int")
    blocks = spark.createDataFrame([(0, 0, 0, 8, 8, bytearray(range(64)))], "scene_id long, block_row int, block_col int, h int, w int, pixels binary")
    for found in (tiles.read_windows(windows, blocks, 8), tiles.read_grid(windows, blocks, 8, 4)):
        assert "REPARTITION_BY_NUM" in plan(found)
        assert [bytes(r["pixels"]) for r in found.collect()] == [bytes(8 * i + j for i in range(4) for j in range(4))]


def test_objects_at_one_place_share_its_patch(spark):
    box = (0.0, 0.0, 2.0, 2.0)
    d = spark.createDataFrame([(i, 10.0, 2.0, 3.0, box, 5) for i in range(3)], f"det_id long, angle180 double, aspect_ra double, diameter_m double, bbox {geometry.BOX}, place long")
    pixels = [float((i * 7) % 11) for i in range(144)]
    shared = texture.object_texture(d, spark.createDataFrame([(5, 12, pixels)], "place long, n int, pixels array<double>"), 2.0, on="place")
    own = texture.object_texture(d.drop("place"), spark.createDataFrame([(i, 12, pixels) for i in range(3)], "det_id long, n int, pixels array<double>"), 2.0)
    assert sorted(map(tuple, shared.collect())) == sorted(map(tuple, own.collect())) and shared.count() == 3


def test_measured_parts_are_found_once_in_bounded_batches(spark):
    a = np.zeros((16, 16))
    a[3:6, 2:11] = 200
    found = sweeps.threshold_measure(140, ["patch_id"])(spark.createDataFrame([(1, 16, a.ravel().tolist())], "patch_id long, n int, pixels array<double>"))
    assert "Join" not in plan(found) and "MapInPandas" not in plan(found)
    (row,) = found.collect()
    assert (row["area"], row["angle180"], row["aspect_ra"]) == (27, pytest.approx(90), pytest.approx((80 / 8) ** 0.5))


def test_rejects_and_predictions_are_computed_once(spark):
    raw = spark.createDataFrame([(0, 1, masks.to_mask(np.ones((2, 2))))], f"scene_id long, category_id int, mask {masks.MASK}")
    found = masks.rejects(raw, spark.createDataFrame([(1,)], "category_id int"), 8, 6, downscale=False)
    assert "MapInArrow" not in plan(found) and [tuple(r) for r in found.collect()] == [(0, "area", 1)]
    d = coco.predictions(spark.createDataFrame([(0, 1, 0, 0.9)], "image_id long, det_id long, category_id int, score double"))
    assert "Window" not in plan(d) and d.count() == 1


def test_pairs_of_more_rows_are_dealt_to_more_tasks(spark, monkeypatch):
    """What a task sorts does not grow with the tables at a fixed number of shuffle partitions."""
    monkeypatch.setattr(stages, "ROWS_A_TASK", 60)
    d = spark.range(300).selectExpr("0L AS scene_id", "id", "cast(id * 37 % 199 AS double) AS x", "cast(id * 53 % 211 AS double) AS y", "1.0D + id % 90 AS area")
    r = d.where("id % 7 = 0").withColumn("x", F.col("x") + 0.25)
    for found in (spatial.nearest_matches(r, d), spatial.unmatched(d, r)):
        text = plan(found)
        parts = [int(n) for n in re.findall(r", (\d+)\), REPARTITION_BY_NUM", text)]
        assert len(parts) in (2, 4) and min(parts) > 4 and "Broadcast" not in text
    xy = {x["id"]: (x["x"], x["y"]) for x in r.collect()}
    near = lambda m: any(np.hypot(m["x"] - x, m["y"] - y) <= max(np.sqrt(m["area"] / np.pi), 1) for x, y in xy.values())
    assert {x["id"] for x in spatial.unmatched(d, r).collect()} == {m["id"] for m in d.collect() if not near(m)}


def test_match_statistics_send_no_table_to_all_tasks(spark):
    """Nor does a task get the ratios of all matches for their median."""
    refs = spark.createDataFrame([(0, i, 100.0 * i, 0.0, 4.0) for i in range(6)], "scene_id long, id long, x double, y double, area double")
    models = refs.where("id < 5").withColumn("area", F.col("area") * (1 + F.col("id")))
    found = spatial.match_statistics(refs, models)
    assert "Broadcast" not in plan(found) and "Nested" not in plan(found) and "percentile" not in plan(found)
    assert tuple(found.first()) == (6, 5, 5, 5 / 6, 3.0, 0.0)
    assert tuple(spatial.match_statistics(refs, models.limit(0)).first()) == (6, 0, 0, 0.0, None, None)


@pytest.mark.parametrize("n", [1, 2, 5000, 5001])
def test_a_median_by_its_bracket_is_exact(spark, n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(0, 1, n), rng.integers(0, 4, n).astype(float)):
        v = spark.createDataFrame([(float(x),) for x in a] + [(None,)], "v double")
        assert spatial.median(v, "v") == pytest.approx(np.median(a), rel=1e-12)


def test_keys_as_large_as_at_6_gb(spark):
    """54 million orders and 36 million events: their keys' squares times a factor leave the range of a long."""
    rest = lambda v, m: (abs(v) % m) * (1 if v >= 0 else -1)
    keys = [-1_000_004, -1_000_003, -7, -1, 0, 5, 999_999, 1_000_003, 34_200_000, 36_000_001, 53_999_999, 2**61 + 9]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    for r in fixtures._boxes(rows).collect():
        k = r["k"]
        assert r["x0"] == rest(k * k * 7919 + k * 104729 + 12345, 1000003) / 1000003 * 2000
        assert r["y0"] == rest(k * k * 6007 + k * 130363 + 777, 1000003) / 1000003 * 2000
        assert (r["w"], r["h"], r["score"]) == (4 + rest(k * 31, 21), 4 + rest(k * 17, 21), 0.05 + rest(k * 48271, 9001) / 10000)
    got = rows.selectExpr("k", f"{fixtures.square_mod('k', 7919, 31337, 99, 18000)} AS v").collect()
    assert [r["v"] for r in got] == [rest(k * k * 7919 + k * 31337 + 99, 18000) for k in keys]


@pytest.mark.parametrize("name, table, first", [("g8_average_precision", "orders", 53_999_000), ("g8_mask_average_precision", "orders", 53_999_000), ("e1_known_angles", "events", 35_999_000)])
def test_queries_with_keys_as_large_as_at_6_gb(spark, tmp_path, name, table, first):
    key = "o_orderkey" if table == "orders" else "event_id"
    spark.range(first, first + 300).selectExpr(f"id AS {key}", "1L AS user_id", "'view' AS event_type").write.parquet(f"{tmp_path}/{table}.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
    if table == "events":
        assert len(rows) == 300 and all(r["fits"] is (None if r["det_id"] % 97 == 0 else True) for r in rows)
    else:
        assert len(rows) == 1 and 0 < rows[0]["ap"] < 1


def crowd(rng, n_truth, n_det, side):
    t = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, side, (n_truth, 2)))]
    return t, [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, side, (n_det, 2)))]


def matched_by(spark, t, d, radius, most=50):
    truth = spark.createDataFrame([(0.0, *x) for x in t], "phi0 double, truth_id long, x double, y double")
    dets = spark.createDataFrame([(0.0, *x, 0.5) for x in d], "phi0 double, det_id long, x double, y double, score double")
    return {r["truth_id"]: r["det_id"] for r in sweeps.greedy_matches(truth, dets, radius, most=most).collect()}


def matched_in_order(t, d, radius):
    ids, xy = np.array([x[0] for x in d]), np.array([x[1:] for x in d])
    free, out = np.ones(len(d), bool), {}
    for i, x, y in t:
        dist = np.where(free, np.hypot(xy[:, 0] - x, xy[:, 1] - y), np.inf)
        j = np.lexsort((ids, dist))[0]
        if dist[j] <= radius:
            free[j], out[i] = False, int(ids[j])
    return out


def test_a_truth_meets_few_detections_however_many_are_near(spark, monkeypatch):
    t, d = crowd(np.random.default_rng(3), 300, 3000, 60.0)
    pairs, real = [], sweeps._decided
    monkeypatch.setattr(sweeps, "_decided", lambda p, *a: pairs.append(p.count()) or real(p, *a))
    assert matched_by(spark, t, d, 18.0) == matched_in_order(t, d, 18.0)
    assert pairs[0] < 25 * len(t)  # within the radius lie over 500 a truth


@pytest.mark.parametrize("enough, n_truth, n_det", [(1, 300, 3000), (1, 400, 500), (3, 900, 700)])
def test_matches_are_exact_where_the_nearest_do_not_suffice(spark, monkeypatch, enough, n_truth, n_det):
    """A truth whose nearest detections are all taken gets those in the whole radius, and later ones of its key are matched anew."""
    monkeypatch.setattr(sweeps, "ENOUGH", enough)
    monkeypatch.setattr(sweeps, "FOR_EACH", 0)
    passes, real = [], sweeps._in_rounds
    monkeypatch.setattr(sweeps, "_in_rounds", lambda *a: passes.append(1) or real(*a))
    t, d = crowd(np.random.default_rng(n_det), n_truth, n_det, 90.0)
    assert matched_by(spark, t, d, 12.0) == matched_in_order(t, d, 12.0)
    assert len(passes) > 1
