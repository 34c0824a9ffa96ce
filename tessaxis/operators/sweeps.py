"""Parameter sweeps: each patch or scene with each parameter (a small table), a kernel per row, aggregates per parameter.

Detections enter as tables, so that any model, run by tiles.detect, fits: measured(patches) maps a patch table (patch_id,
parameter columns, n, pixels) to detections (the same keys, local_id, cx, cy, angle180, aspect_ra, area, score).
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessaxis.functions import axial, geometry, images
from tessaxis.operators import masks, orientation, tiles
from tessaxis.sources.stages import dropped, merged, written

Measure = Callable[[DataFrame], DataFrame]


def crossed(patches: DataFrame, parameters: DataFrame) -> DataFrame:
    """Each patch with each row of parameters; parameters is broadcast, so it must be small."""
    return patches.crossJoin(F.broadcast(parameters))


def _mapped(df: DataFrame, run_row) -> DataFrame:
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [run_row(np.asarray(r["pixels"], float).reshape(r["n"], -1), r) for r in pdf.to_dict("records")]
            yield pdf.assign(pixels=[m.ravel() for m in made], n=[m.shape[0] for m in made])[names]

    return df.mapInPandas(run, df.schema)


def rotated(patches: DataFrame, parameters: DataFrame, order: int | None = 3) -> DataFrame:
    """Patches turned by column alpha; the spline order is fixed or a column `order`."""
    return _mapped(crossed(patches, parameters), lambda a, r: images.rotate(a, r["alpha"], r["order"] if order is None else order))


def rescaled(patches: DataFrame, parameters: DataFrame, least: int = 32) -> DataFrame:
    """Patches resized by column factor: area means when smaller, cubic when larger, sides of `least` or more."""

    def one(a, r):
        h, w = (max(least, round(s * r["factor"])) for s in a.shape)
        return images.resize(a, h, w, "area" if r["factor"] < 1 else "cubic")

    return _mapped(crossed(patches, parameters), one)


def threshold_measure(level: float, by: list[str], min_pixels: int = 5) -> Measure:
    """A stand-in for a model: parts over a level, with moment orientation; its detections have the columns of Measure."""

    def measure(patches: DataFrame) -> DataFrame:
        keys = [c for c in by if c in patches.columns]
        schema = ", ".join(f"{c} {patches.schema[c].dataType.simpleString()}" for c in keys) + ", local_id int, cx double, cy double, score double, mask " + masks.MASK + ", m double, xx double, yy double, xy double"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for r in pdf.to_dict("records"):
                    a = np.asarray(r["pixels"], float).reshape(r["n"], -1)
                    label, n = images.components(a > level)
                    for i in range(1, n + 1):
                        m = label == i
                        if m.sum() >= min_pixels:
                            ys, xs = np.nonzero(m)
                            dx, dy = xs - xs.mean(), ys.mean() - ys
                            rows.append((*(r[c] for c in keys), i, float(xs.mean()), float(ys.mean()), float(a[m].mean()), masks.to_mask(m), float(len(xs)), float((dx * dx).mean()), float((dy * dy).mean()), float((dx * dy).mean())))
                yield pd.DataFrame(rows, columns=[*keys, "local_id", "cx", "cy", "score", "mask", "m", "xx", "yy", "xy"])

        found = written(patches.mapInPandas(run, schema))  # once, and in batches of few bytes
        return found.select(*keys, "local_id", "cx", "cy", "score", "mask", *orientation.moment_axes(), F.col("m").alias("area"))

    return measure


def detections_in_place(scenes: DataFrame, blocks: DataFrame, block: int, size: int, measure: Measure) -> DataFrame:
    """Detections of non-overlapping tiles, border tiles of 32 pixels or more included, at scene pixels; failed fits stay."""
    grid = tiles.plain_grid(scenes, size, ragged_least=32)
    cut = tiles.read_grid(grid, blocks, block, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"scene_id": pdf["scene_id"], "patch_id": pdf["tile_id"], "x0": pdf["x0"], "y0": pdf["y0"], "n": pdf["sh"], "pixels": [np.frombuffer(x, np.uint8).astype(float) for x in pdf["pixels"]]})

    found = measure(cut.mapInPandas(run, "scene_id long, patch_id long, x0 int, y0 int, n int, pixels array<double>"))
    return found.withColumn("cx_img", F.col("cx") + F.col("x0")).withColumn("cy_img", F.col("cy") + F.col("y0"))


def detect_orientations(scenes: DataFrame, blocks: DataFrame, block: int, size: int, measure: Measure, aspect_min: float = 1.35) -> DataFrame:
    """Detections of full non-overlapping tiles with an angle and aspect_min or more."""
    cut = tiles.read_grid(tiles.plain_grid(scenes, size), blocks, block, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"scene_id": pdf["scene_id"], "patch_id": pdf["tile_id"], "n": pdf["sh"], "pixels": [np.frombuffer(x, np.uint8).astype(float) for x in pdf["pixels"]]})

    found = measure(cut.mapInPandas(run, "scene_id long, patch_id long, n int, pixels array<double>"))
    return elongated(found, aspect_min)


def elongated(dets: DataFrame, aspect_min: float = 1.35) -> DataFrame:
    """Detections with an angle and aspect_min or more: near-round ones have arbitrary angles."""
    return dets.where(F.col("angle180").isNotNull() & (F.col("aspect_ra") >= aspect_min))


def population_sweep(dets: DataFrame, alphas: DataFrame, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """Per alpha: n, raw_peak with bounds, and the same turned back: geo_peak, geo_lo, geo_hi; null without detections."""
    ci = orientation.bootstrap_peaks(dets, ["alpha"], n_boot, seed=seed)
    counts = dets.groupBy("alpha").agg(F.count("angle180").alias("n"))
    back = lambda c: axial.folded(F.col(c) + F.col("alpha"))
    found = alphas.select("alpha").join(counts, "alpha", "left").join(ci, "alpha", "left")
    return found.select("alpha", F.coalesce("n", F.lit(0)).alias("n"), F.col("peak_deg").alias("raw_peak"), "lo_deg", "hi_deg", back("peak_deg").alias("geo_peak"), back("lo_deg").alias("geo_lo"), back("hi_deg").alias("geo_hi"))


def rotation_residuals(base: DataFrame, turned: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Per object and alpha: ang0, ang_back, residual, grid_dist0 (and truth_residual).

    base: patch_id, angle180 at alpha 0; turned: patch_id, alpha, angle180; truth: patch_id, true_angle.
    """
    back = axial.folded(F.col("angle180") + F.col("alpha"))
    found = turned.select("patch_id", "alpha", back.alias("ang_back")).join(base.select("patch_id", F.col("angle180").alias("ang0")), "patch_id")
    found = found.withColumn("residual", axial.distance(F.col("ang0"), F.col("ang_back"))).withColumn("grid_dist0", axial.grid_distance(F.col("ang0")))
    if truth is not None:
        found = found.join(truth, "patch_id").withColumn("truth_residual", axial.distance(F.col("true_angle"), F.col("ang_back")))
    return found


def rotation_slope(sweep: DataFrame, by: list[str] = (), skip_right_angles: bool = True) -> DataFrame:
    """Per group the slope of raw_peak, unwrapped on 180 degrees in order of alpha: raw_slope, geo_slope, intercept, n."""
    by = list(by)
    rows = sweep.where(F.col("raw_peak").isNotNull())
    if skip_right_angles:
        rows = rows.where(F.pmod("alpha", F.lit(90)) != 0)
    order = Window.partitionBy(*by).orderBy("alpha") if by else Window.partitionBy(F.lit(0)).orderBy("alpha")
    step = F.col("raw_peak") - F.lag("raw_peak").over(order)
    # numpy's unwrap leaves a step of exactly half a period with its sign
    wrapped = F.pmod(step + 90.0, F.lit(180.0)) - 90.0
    wrapped = F.when((wrapped == -90.0) & (step > 0), F.lit(90.0)).otherwise(wrapped)
    rows = rows.withColumn("_step", F.when(F.abs(step) < 90.0, step).otherwise(wrapped))
    rows = rows.withColumn("_raw", F.first("raw_peak").over(order) + F.sum(F.coalesce("_step", F.lit(0.0))).over(order))
    fit = rows.groupBy(*by).agg(F.regr_slope("_raw", "alpha").alias("s"), F.regr_intercept("_raw", "alpha").alias("i"), F.count("*").alias("n"))
    enough = F.col("n") >= 2
    return fit.select(*by, F.when(enough, F.col("s")).alias("raw_slope"), F.when(enough, F.col("s") + 1).alias("geo_slope"), F.when(enough, F.col("i")).alias("intercept"), "n")


def residual_histogram(res: DataFrame, by: list[str], width: float = 5.0) -> DataFrame:
    """Density of residuals on [0, 90] in bins of a width, with the group's median: by, bin, density, median."""
    n = int(90 / width)
    rows = res.where(F.col("residual").isNotNull())
    counts = rows.groupBy(*by, F.least(F.floor(F.col("residual") / width), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("c"))
    mids = rows.groupBy(*by).agg(F.percentile("residual", 0.5).alias("median"), F.count("*").alias("all"))
    joined = counts.join(mids, by) if by else counts.crossJoin(mids)
    return joined.select(*by, "bin", (F.col("c") / (F.col("all") * width)).alias("density"), "median")


def snapping(res: DataFrame, by: list[str] = ()) -> DataFrame:
    """Median residual by the first angle's distance to the grid: [0, 7.5), [7.5, 15), [15, 22.5): by, bin, median, n."""
    rows = res.where((F.col("grid_dist0") < 22.5) & F.col("residual").isNotNull())
    return rows.groupBy(*by, F.floor(F.col("grid_dist0") / 7.5).alias("bin")).agg(F.percentile("residual", 0.5).alias("median"), F.count("*").alias("n"))


def rotation_strip(frames: DataFrame, size_column: str = "n", drift_px: float = 12.0, ratio: tuple[float, float] = (0.6, 1.8)) -> DataFrame:
    """Frames (patch_id, alpha, angle180, area, cx, cy, n) with ref_rot, ang_back, residual, area_ratio, drift and unstable.

    The frame of the lowest alpha of each object is its reference.
    """
    order = Window.partitionBy("patch_id").orderBy("alpha").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ref, area0 = F.first("angle180").over(order), F.first("area").over(order)
    half = F.col(size_column) / 2
    found = frames.withColumn("ref_rot", axial.folded(ref - F.col("alpha"))).withColumn("ang_back", axial.folded(F.col("angle180") + F.col("alpha")))
    found = found.withColumn("residual", axial.distance(ref, F.col("ang_back"))).withColumn("area_ratio", F.try_divide("area", area0)).withColumn("drift", F.hypot(F.col("cx") - half, F.col("cy") - half))
    return found.withColumn("unstable", (F.col("drift") > drift_px) | ~F.coalesce(F.col("area_ratio").between(*ratio), F.lit(True)))


def resolution_sweep(dets: DataFrame, base_res: float, n_boot: int = 200, seed: int = 0) -> DataFrame:
    """Per factor: eff_mpp, n, peak and bounds; dets: factor, angle180."""
    counts = dets.groupBy("factor").agg(F.count("angle180").alias("n"))
    return counts.join(orientation.bootstrap_peaks(dets, ["factor"], n_boot, seed=seed), "factor").withColumn("eff_mpp", base_res / F.col("factor"))


def kernel_sweep(dets: DataFrame, tol: float = 10.0) -> DataFrame:
    """Per spline order: n, diagonal fraction and peak; dets: order, angle180."""
    dens = orientation.density(dets, ["order"])
    stats = dets.groupBy("order").agg(F.count("angle180").alias("n"), axial.diagonal_fraction(F.col("angle180"), tol).alias("diagonal_fraction"))
    return stats.join(orientation.peaks(dens, ["order"]), "order")


def pooled_angles(dets: DataFrame) -> DataFrame:
    """All rotations' angles turned back: angle180."""
    return dets.where(F.col("angle180").isNotNull()).select(axial.folded(F.col("angle180") + F.col("alpha")).alias("angle180"))


#: Truths that are matched together at most.
TRUTHS_A_BLOCK = 2000


def greedy_matches(truth: DataFrame, dets: DataFrame, radius: float, key: str = "phi0", most: int = TRUTHS_A_BLOCK) -> DataFrame:
    """One-to-one matches in the order of truth ids, each with the nearest detection left within radius: key, truth_id, det_id, dist, score.

    truth: key, truth_id, x, y; dets: key, det_id, x, y, score. In rounds: truths are dealt out by blocks, cells of the
    plane with at most `most` truths each. A truth is final as soon as no earlier one that is still open, in its block or
    in another, can want its nearest detection left; inside a block this is decided in order, so that chains of truths
    cross a block in one round. A task holds one truth's candidates and the ids that its block has used.

    A truth first meets its nearest detections only, where they are many, so pairs grow with the tables and not with their
    square. As long as no such truth finds all of these used, each has taken what it would have taken of all in the radius.
    Else the keys of such truths are matched again, first with the radius for these truths, then for all.
    """
    # cells that hold about `most` truths, wide enough for a detection's candidates to lie in four at most
    (n, w, h) = truth.agg(F.count("*") / F.greatest(F.count_distinct(key), F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    w, h = sorted((w or 0.0, h or 0.0))
    side = max((w * h * most / max(n, 1)) ** 0.5, 8 * radius)
    side = max(h * most / max(n, 1), side) if side > w else side
    cell = lambda c: F.floor(F.col(c) / side)
    order = Window.partitionBy(key, "cx", "cy").orderBy("truth_id")
    a = first_reach(truth.select(key, "truth_id", "x", "y").where(F.col(key).isNotNull()), dets.select(key, "x", "y"), radius, key).select("*", cell("x").alias("cx"), cell("y").alias("cy"))
    a = a.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / most)).select(key, "truth_id", "x", "y", "r", "k", F.struct("cx", "cy", "chunk").alias("block"))
    asking, out = written(a), None
    for widened in ("short", "all", None):
        found = _in_rounds(asking, dets, radius, key)
        short = written(asking.where(F.col("r") < radius).join(merged(found.select(key, "truth_id")), [key, "truth_id"], "left_anti").select(key, "truth_id"))
        again = short.select(key).distinct()
        is_done = widened is None or short.isEmpty()
        final = found if is_done else found.join(merged(again), key, "left_anti")
        out = final if out is None else out.unionByName(final)
        if is_done:
            break
        rest = asking.join(merged(again), key, "left_semi")
        if widened == "short":
            rest = rest.join(merged(short.withColumn("_short", F.lit(True))), [key, "truth_id"], "left")
        asking = written(rest.withColumn("r", F.when(F.col("_short"), F.lit(radius)).otherwise(F.col("r")) if widened == "short" else F.lit(radius)).select(*asking.columns))
    return out


#: Detections that a first reach holds, and further ones for each other truth in it; rows of the curve that it is taken from, on either side.
ENOUGH, FOR_EACH, LOOKED_AT = 8, 2, 16
#: The least reach, as a share of the radius.
LEAST_REACH = 1 / 32


def first_reach(truth: DataFrame, dets: DataFrame, radius: float, key: str) -> DataFrame:
    """truth (key, truth_id, x, y) with r: the radius, or a smaller one that holds k detections (key, x, y), ENOUGH more than other truths will take there.

    Both are sorted along a curve over all tasks; what lies before and after a truth in its batch tells. Where truths are
    as many as detections, r is the radius.
    """
    from tessaxis.operators.spatial import _curve

    kinds = ", ".join(f"`{c}` {truth.schema[c].dataType.simpleString()}" for c in (key, "truth_id"))
    both = truth.withColumn("is_truth", F.lit(True)).unionByName(dets.withColumn("is_truth", F.lit(False)), allowMissingColumns=True)
    keyed = both.select(key, "truth_id", F.col("x").cast("double"), F.col("y").cast("double"), "is_truth", *_curve(F.col("x"), F.col("y"), 64 * radius))
    order = [key, "_cx", "_cy", "_z", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, is_truth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "is_truth"))
            codes = batch.column(key).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            own, other = np.flatnonzero(is_truth), np.flatnonzero(~is_truth)

            def apart(rows: np.ndarray, at: np.ndarray, steps: list[int], x=x, y=y, codes=codes, own=own) -> np.ndarray:
                """Distances of each truth from the rows so many steps on from a place in `rows`; infinite where there is none."""
                out = np.full((len(steps), len(own)), np.inf)
                for d, step in zip(out, steps, strict=True):
                    place = at + step
                    ok = (place >= 0) & (place < len(rows))
                    ok[ok] = codes[rows[place[ok]]] == codes[own[ok]]
                    d[ok] = np.hypot(x[rows[place[ok]]] - x[own[ok]], y[rows[place[ok]]] - y[own[ok]])
                return np.where(np.isnan(out), np.inf, out)

            near = np.sort(apart(other, np.searchsorted(other, own), list(range(-LOOKED_AT, LOOKED_AT))), axis=0)
            rivals = apart(own, np.arange(len(own)), [i for i in range(-LOOKED_AT // 2, LOOKED_AT // 2 + 1) if i])
            r, k = np.full(len(own), float(radius)), np.zeros(len(own), np.int32)
            for j in range(len(near) - 1, ENOUGH - 2, -1):
                holds = j + 1 >= ENOUGH + FOR_EACH * (rivals <= near[j]).sum(0)
                holds &= near[j] < radius
                r[holds], k[holds] = near[j][holds], j + 1
            r = np.minimum(np.maximum(r * (1 + 1e-9), radius * LEAST_REACH), radius)
            taken = pa.array(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in (key, "truth_id", "x", "y")), pa.array(r), pa.array(k)], [key, "truth_id", "x", "y", "r", "k"])

    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(key, "truth_id", "x", "y", "is_truth")
    return placed.mapInArrow(run, f"{kinds}, x double, y double, r double, k int")


def _in_rounds(asking: DataFrame, dets: DataFrame, radius: float, key: str) -> DataFrame:
    """The greedy matches if each truth has only the detections within r, or the k nearest if r is less than the radius: key, truth_id, det_id, dist, score."""
    from tessaxis.operators.spatial import sized_pairs

    at = lambda d: geometry.box(F.col("x") - d, F.col("y") - d, F.col("x") + d, F.col("y") + d)
    # the distance, as rounded, decides, not the box
    a = asking.select(key, "truth_id", "block", "r", "k", F.col("x").alias("x_a"), F.col("y").alias("y_a"), at(F.col("r") + 1e-9 * radius).alias("box_a"))
    b = dets.select(key, "det_id", "score", geometry.box(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("box_b"))
    dist = F.hypot(F.col("x_a") - F.col("box_b.xmin"), F.col("y_a") - F.col("box_b.ymin"))
    near = sized_pairs(a, b, [key]).withColumn("dist", dist).where("dist <= r")
    nearest = F.row_number().over(Window.partitionBy(key, "truth_id").orderBy("dist", "det_id"))
    left = written(near.withColumn("_n", nearest).where((F.col("_n") <= F.col("k")) | (F.col("r") >= radius)).select(key, "truth_id", "det_id", "score", "dist", "block"))
    found = []
    while n := left.count():
        decided = written(_decided(left, key, n))
        found.append(decided.where("det_id IS NOT NULL"))
        rest = left.join(merged(decided.select(key, "truth_id")), [key, "truth_id"], "left_anti").join(merged(found[-1].select(key, "det_id")), [key, "det_id"], "left_anti")
        last, left = left, written(rest)
        dropped(last)
    if not found:
        return left.select(key, "truth_id", "det_id", "dist", "score")
    return reduce(DataFrame.unionByName, found)


#: Pairs that a task of a round walks through, where that makes fewer tasks than a shuffle has.
PAIRS_A_TASK = 50_000


def _decided(pairs: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Of n pairs, the truths that are final: key, truth_id and the detection taken, null if none is left."""
    firsts = pairs.groupBy(key, "det_id", "block").agg(F.min("truth_id").alias("t"))
    two = firsts.groupBy(key, "det_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("t", "block"))), 1, 2).alias("two"))
    first, second = F.col("two")[0], F.try_element_at("two", F.lit(2))
    other = F.when(first["block"] == F.col("block"), second["t"]).otherwise(first["t"]).alias("other")  # the first truth of other blocks that may take the detection
    known = pairs.join(merged(two), [key, "det_id"]).select(key, "block", "truth_id", "dist", "det_id", "score", other)
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in (key, "truth_id", "det_id", "dist", "score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = truth = None
        wanted: list[tuple] = []
        used: set = set()
        unsure: set = set()

        def decide(rows: list[tuple]) -> None:
            """The truth whose candidates, nearest first, are in `wanted`."""
            free = [w for w in wanted if w[0] not in used]
            if free and (free[0][0] in unsure or free[0][3] is not None and free[0][3] < truth):
                unsure.update(w[0] for w in free)
            elif free:
                used.add(free[0][0])
                rows.append((place[0], truth, *free[0][:3]))
            else:
                rows.append((place[0], truth, None, None, None))

        names = [key, "truth_id", "det_id", "dist", "score"]
        kinds: list = []
        for batch in batches:
            rows: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in (key, "cx", "cy", "chunk", "truth_id", "det_id", "dist", "score", "other")]
            for k, cx, cy, chunk, t, *candidate in zip(*columns, strict=True):
                if (k, cx, cy, chunk, t) != (*(place or (None,) * 4), truth):
                    if wanted:
                        decide(rows)
                    if (k, cx, cy, chunk) != place:
                        place, used, unsure = (k, cx, cy, chunk), set(), set()
                    truth, wanted = t, []
                wanted.append(candidate)
            kinds = [batch.schema.field(c).type for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names)
        if wanted:
            rows = []
            decide(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts if n is None else max(1, min(parts, -(-n // PAIRS_A_TASK)))
    flat = known.select(key, "block.cx", "block.cy", "block.chunk", "truth_id", "dist", "det_id", "score", "other")
    place = [key, "cx", "cy", "chunk"]
    return flat.repartition(parts, *place).sortWithinPartitions(*place, "truth_id", "dist", "det_id").mapInArrow(run, schema)


def recall_sweep(truth: DataFrame, dets: DataFrame, radius: float, key: str = "phi0") -> DataFrame:
    """Per key: n_truth, n_det, n_matched, recall, mean_conf_matched, mean_conf_all; without detections recall is 0."""
    matched = greedy_matches(truth, dets, radius, key).groupBy(key).agg(F.count("*").alias("n_matched"), F.avg("score").alias("mean_conf_matched"))
    n_det = dets.groupBy(key).agg(F.count("*").alias("n_det"), F.avg("score").alias("mean_conf_all"))
    found = truth.groupBy(key).agg(F.count("*").alias("n_truth")).join(n_det, key, "left").join(matched, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return found.select(key, "n_truth", zero("n_det"), zero("n_matched"), (F.coalesce("n_matched", F.lit(0)) / F.col("n_truth")).alias("recall"), "mean_conf_matched", "mean_conf_all")


def same_mask_residuals(base: DataFrame, turned: DataFrame, pairs: DataFrame, iou_min: float = 0.3) -> DataFrame:
    """Rotation residuals with the check that the same object was found: base x alphas, undetected ones kept.

    base: patch_id, angle180; turned: patch_id, alpha, angle180; pairs: patch_id, alpha, iou of the turned first mask with
    the mask found. Columns: patch_id, alpha, ang0, ang_back, residual, grid_dist0, iou, is_same_mask.
    """
    spine = base.select("patch_id", F.col("angle180").alias("ang0")).crossJoin(F.broadcast(pairs.select("alpha").distinct()))
    found = spine.join(turned.select("patch_id", "alpha", "angle180"), ["patch_id", "alpha"], "left").join(pairs, ["patch_id", "alpha"], "left")
    seen = F.col("angle180").isNotNull()
    back = axial.folded(F.col("angle180") + F.col("alpha"))
    iou = F.when(seen, F.coalesce("iou", F.lit(0.0))).otherwise(0.0)
    return found.select("patch_id", "alpha", "ang0", back.alias("ang_back"), axial.distance(F.col("ang0"), back).alias("residual"), axial.grid_distance(F.col("ang0")).alias("grid_dist0"), iou.alias("iou"), (iou >= iou_min).alias("is_same_mask"))


def turned_mask_iou(base: DataFrame, turned: DataFrame) -> DataFrame:
    """patch_id, alpha, iou of each base mask (patch_id, mask) turned by alpha, linearly, with the mask found there (patch_id, alpha, mask)."""
    both = turned.select("patch_id", "alpha", "mask").join(base.select("patch_id", F.col("mask").alias("mask0")), "patch_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a = images.rotate(masks.to_array(r["mask0"]), r["alpha"], 1) >= 0.5
                b = masks.to_array(r["mask"]) > 0
                rows.append((r["patch_id"], r["alpha"], float((a & b).sum() / max((a | b).sum(), 1))))
            yield pd.DataFrame(rows, columns=["patch_id", "alpha", "iou"])

    return both.mapInPandas(run, f"patch_id long, alpha {turned.schema['alpha'].dataType.simpleString()}, iou double")


def dropout(residuals: DataFrame) -> DataFrame:
    """Per alpha the share of objects whose mask is not the same: alpha, dropout, n."""
    return residuals.groupBy("alpha").agg(F.avg((~F.col("is_same_mask")).cast("int")).alias("dropout"), F.count("*").alias("n"))


def object_patch_table(dets: DataFrame, scenes: DataFrame, blocks: DataFrame, block: int, size: int, n: int = 200, aspect_min: float = 1.6, diameter_px: tuple[float, float] = (5, 16), valid_min: float = 0.9, seed: int = 0) -> DataFrame:
    """Patches around n drawn elongated objects of fitting size; too empty windows go after the draw, so fewer may return."""
    sized = dets.join(scenes.select("scene_id", "res"), "scene_id").where((F.col("aspect_ra") > aspect_min) & (F.col("diameter_m") / F.col("res")).between(*diameter_px))
    drawn = orientation.sample_n(sized, n, "det_id", seed)
    points = drawn.select("scene_id", F.col("det_id").alias("point_id"), F.col("center.x").alias("x"), F.col("center.y").alias("y"))
    found = tiles.read_windows(tiles.centered_windows(points, scenes, size), blocks, block, "point_id")
    return tiles.with_statistics(found).where(F.col("valid") >= valid_min)
