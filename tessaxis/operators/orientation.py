"""Orientation of objects: ellipse fits, moments, histograms on the half circle, smoothed densities, peaks, intervals.

All statistics work per group of any columns `by`. After the first histogram the data is 180 rows a group.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.functions import axial, geometry, images
from tessaxis.sources.layers import sample_n
from tessaxis.sources.stages import merged, spread


def _fitted(df: DataFrame, ring: str, spacing: float | Column | None, names: list[str], fit) -> DataFrame:
    """df with double columns that fit(x, y, n) gives for all rings of a batch; NaN becomes null.

    With a spacing, rings are densified first, in the tasks' arrays; without a value of it a fit fails.
    """
    thin = isinstance(spacing, Column) or bool(spacing)
    if thin:
        df = df.withColumn("_spacing", (spacing if isinstance(spacing, Column) else F.lit(spacing)).cast("double"))
    kept = [f for f in df.schema.fields if f.name not in ("_spacing", *names)]
    schema = T.StructType([*kept, *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings = batch.column(ring)
            points = rings.flatten()
            n = pc.list_value_length(rings).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            if thin:
                space = batch.column("_spacing").to_numpy(zero_copy_only=False).astype(float)
                known = ~np.isnan(space)
                own = np.repeat(known, n)
                x, y, n = images.densified(x[own], y[own], np.where(known, n, 0), space)
            found = fit(x, y, n)
            made = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], schema.names)

    return df.select(*(f.name for f in kept), *["_spacing"] * thin).mapInArrow(run, schema)


def ellipse_fits(df: DataFrame, ring: str = "geometry", spacing: float | Column | None = None) -> DataFrame:
    """df with angle180 and aspect_ra of the ellipse fitted to each ring (y north); null where the fit fails.

    With a spacing, rings are densified first. All vertices count, the repeated closing one too.
    """
    return _fitted(df, ring, spacing, ["angle180", "aspect_ra"], images.fit_ellipses)


def attach_orientations(dets: DataFrame, res: float | Column, ring: str = "geometry") -> DataFrame:
    """dets with angle180, aspect_ra and diameter_m; failed fits keep their row."""
    return ellipse_fits(dets, ring, res).withColumn("diameter_m", geometry.diameter(geometry.area(F.col(ring))))


def orientations(dets: DataFrame, res: float | Column, sample: int | None = None, seed: int = 0, key: str = "det_id") -> DataFrame:
    """Orientation table: fits of all or of `sample` detections, failures dropped."""
    return attach_orientations(sample_n(dets, sample, key, seed) if sample else dets, res).dropna(subset=["angle180"])


def well_resolved(df: DataFrame, res: float, aspect_min: float = 1.35, pixels_min: float = 8) -> DataFrame:
    return df.where(axial.well_resolved(F.col("aspect_ra"), F.col("diameter_m"), res, aspect_min, pixels_min))


def moment_orientations(px: DataFrame, key: str = "det_id") -> DataFrame:
    """Long-axis azimuth and aspect from the weighted moments of mask_pixels: key, angle180, aspect_ra."""
    w, x, y = F.col("w"), F.col("col").cast("double"), -F.col("row").cast("double")
    of = Window.partitionBy(key)  # a mask's pixels meet in one task, once
    px = spread(px.select(key, "row", "col", "w").where(F.col(key).isNotNull()), key).withColumns({"m": F.sum(w).over(of), "mx": F.try_divide(F.sum(w * x).over(of), F.sum(w).over(of)), "my": F.try_divide(F.sum(w * y).over(of), F.sum(w).over(of))})
    dx, dy = x - F.col("mx"), y - F.col("my")
    sums = px.groupBy(key).agg(F.max("m").alias("m"), (F.sum(w * dx * dx) / F.max("m")).alias("xx"), (F.sum(w * dy * dy) / F.max("m")).alias("yy"), (F.sum(w * dx * dy) / F.max("m")).alias("xy"))
    return sums.select(key, *moment_axes())


def moment_axes() -> list[Column]:
    """angle180 and aspect_ra of a weight m with the moments xx, yy and xy about its mean."""
    apart = F.hypot(F.col("xx") - F.col("yy"), 2 * F.col("xy"))
    l1, l2 = (F.col("xx") + F.col("yy") + apart) / 2, (F.col("xx") + F.col("yy") - apart) / 2
    # the main axis lies at half the angle of (xx - yy, 2 xy) from east
    theta = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    good = (F.col("m") > 0) & (l1 > 0)
    return [F.when(good, axial.azimuth(F.cos(theta), F.sin(theta))).alias("angle180"), F.when(good, F.sqrt(l1 / F.greatest(l2, F.lit(1e-12)))).alias("aspect_ra")]


def traced_orientations(df: DataFrame, tracer: str, key: str = "det_id") -> DataFrame:
    """Azimuth and aspect of mask contours by one tracer, y flipped north; empty masks give a null row."""
    from tessaxis.operators.masks import contours

    found = contours(df.select(key, "mask"), tracer)
    north = F.transform("polygon", lambda v: geometry.point(v["x"], -v["y"]))
    return ellipse_fits(found.withColumn("geometry", F.when(F.size("polygon") >= 3, north)).drop("mask", "polygon"), "geometry", 1.0).drop("geometry")


def compare_tracers(df: DataFrame, key: str = "det_id") -> DataFrame:
    """Both tracers' angles side by side: key, angle_isoline, angle_border, difference."""
    df = spread(df.select(key, "mask"), key)
    a = traced_orientations(df, "isoline", key).select(key, F.col("angle180").alias("angle_isoline"))
    b = traced_orientations(df, "border", key).select(key, F.col("angle180").alias("angle_border"))
    return a.join(merged(b), key).withColumn("difference", axial.distance(F.col("angle_isoline"), F.col("angle_border")))


def scene_fractions(df: DataFrame, by: list[str], tol: float = 10.0) -> DataFrame:
    """Per group: n, grid and diagonal fractions with their uniform baseline, and the 135/45 asymmetry."""
    a = F.col("angle180")
    return df.groupBy(*by).agg(F.count("angle180").alias("n"), axial.grid_fraction(a, tol).alias("grid_fraction"), axial.diagonal_fraction(a, tol).alias("diagonal_fraction"), F.lit(axial.uniform_fraction(tol)).alias("uniform_fraction"), axial.asymmetry(a, tol).alias("asymmetry"))


def histogram(df: DataFrame, by: list[str], nbins: int = 180, angle: str = "angle180", weight: Column | None = None) -> DataFrame:
    """Counts (or sums of a weight) in each of nbins bins of [0, 180): by, bin, c; empty bins are 0. Null angles are no rows."""
    a = axial.folded(F.col(angle))
    bin_ = F.least(F.floor(a * nbins / 180.0), F.lit(nbins - 1))
    counts = df.where(F.col(angle).isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("c"))
    spine = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    spine = spine.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nbins - 1).cast("long"))))
    return spine.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("c", F.lit(0.0)).alias("c"))


def kernel(spark, n: int, sigma: float) -> DataFrame:
    """Rows (i, bin, k): wrap-around Gaussian weights, each i's summing to 1."""
    grid = spark.range(n).withColumnRenamed("id", "i").crossJoin(spark.range(n).withColumnRenamed("id", "bin"))
    d = F.least(F.abs(F.col("i") - F.col("bin")), n - F.abs(F.col("i") - F.col("bin")))
    k = F.exp(-0.5 * F.pow(d / sigma, F.lit(2)))
    return grid.withColumn("k", k / F.sum(k).over(Window.partitionBy("i")))


def smoothed(hist: DataFrame, by: list[str], n: int, sigma: float = 4.0) -> DataFrame:
    """A histogram smoothed around the circle: by, bin, d."""
    k = kernel(hist.sparkSession, n, sigma)
    return hist.join(F.broadcast(k), "bin").groupBy(*by, "i").agg(F.sum(F.col("k") * F.col("c")).alias("d")).withColumnRenamed("i", "bin")


def density(df: DataFrame, by: list[str], sigma: float = 4.0, nbins: int = 180, angle: str = "angle180") -> DataFrame:
    """Smoothed density in percent: by, bin, center_deg, percent; groups without angles get zeros."""
    return _as_percent(smoothed(histogram(df, by, nbins, angle), by, nbins, sigma), by, nbins)


def _as_percent(d: DataFrame, by: list[str], nbins: int) -> DataFrame:
    total = F.sum("d").over(Window.partitionBy(*by)) if by else F.sum("d").over(Window.partitionBy(F.lit(0)))
    return d.select(*by, "bin", ((F.col("bin") + 0.5) * (180.0 / nbins)).alias("center_deg"), F.coalesce(F.try_divide(100 * F.col("d"), total), F.lit(0.0)).alias("percent"))


def peaks(dens: DataFrame, by: list[str], nbins: int = 180) -> DataFrame:
    """Per group the mode of a density (by, bin, percent) between bins, by a parabola through the first highest and its neighbours."""
    points = F.sort_array(F.collect_list(F.struct("bin", "percent")))
    per = dens.groupBy(*by).agg(F.transform(points, lambda p: p["percent"]).alias("d"), F.max_by("bin", F.struct("percent", -F.col("bin"))).alias("i"))
    at = lambda k: F.element_at("d", (F.pmod(F.col("i") + k, F.lit(nbins)) + 1).cast("int"))
    y0, y1, y2 = at(-1), at(0), at(1)
    step = F.coalesce(F.try_divide(0.5 * (y0 - y2), y0 - 2 * y1 + y2), F.lit(0.0))
    return per.select(*by, F.pmod((F.col("i") + 0.5) * (180.0 / nbins) + step * (180.0 / nbins), F.lit(180.0)).alias("peak_deg"))


def bootstrap_peaks(df: DataFrame, by: list[str], n_boot: int = 400, ci: tuple[float, float] = (2.5, 97.5), sigma: float = 4.0, seed: int = 0) -> DataFrame:
    """Per group the peak and the percentiles of its bootstrap: by, peak_deg, lo_deg, hi_deg; null without angles.

    A peak depends on the histogram only, so a resample of n angles is a multinomial draw over 180 counts: each group and
    replicate is one row of counts.
    """
    hist = histogram(df, by)
    per = hist.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "c"))), lambda p: p["c"]).alias("counts"))
    reps = per.withColumn("boot", F.explode(F.sequence(F.lit(-1), F.lit(n_boot - 1))))
    key = F.xxhash64(F.lit(seed), *by, "boot")
    schema = T.StructType([*(per.schema[c] for c in by), T.StructField("boot", T.IntegerType()), T.StructField("peak", T.DoubleType())])
    i = np.arange(180)
    gap = np.minimum(np.abs(i - i[:, None]), 180 - np.abs(i - i[:, None]))
    k = np.exp(-0.5 * (gap / sigma) ** 2)
    k /= k.sum(1, keepdims=True)

    def peak(c: np.ndarray) -> float:
        d = k @ c
        j = int(np.argmax(d))
        y0, y1, y2 = d[j - 1], d[j], d[(j + 1) % 180]
        bend = y0 - 2 * y1 + y2
        return float((j + 0.5 + (0.5 * (y0 - y2) / bend if bend else 0.0)) % 180)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, b, s in zip(pdf["counts"], pdf["boot"], pdf["_seed"], strict=True):
                c = np.asarray(c, float)
                n = int(c.sum())
                if n and b >= 0:
                    c = np.random.default_rng(int(s) & (2**63 - 1)).multinomial(n, c / n).astype(float)
                out.append(peak(c) if n else None)
            yield pdf.assign(peak=pd.Series(out, index=pdf.index, dtype="Float64"))[schema.names]

    drawn = reps.withColumn("_seed", key).repartition(*([*by, "boot"])).mapInPandas(run, schema)
    q = F.percentile(F.when(F.col("boot") >= 0, F.col("peak")), F.array(F.lit(ci[0] / 100), F.lit(ci[1] / 100)))
    got = drawn.groupBy(*by).agg(F.max(F.when(F.col("boot") < 0, F.col("peak"))).alias("peak_deg"), q.alias("q"))
    return got.select(*by, "peak_deg", F.col("q")[0].alias("lo_deg"), F.col("q")[1].alias("hi_deg"))


def rose(df: DataFrame, by: list[str], bins: int = 36, angle: str = "angle180") -> DataFrame:
    """Shares of azimuths mirrored to the full circle in 2 * bins bins: by, bin, share."""
    n = 2 * bins
    both = df.where(F.col(angle).isNotNull()).withColumn("_a", F.explode(F.array(axial.folded(F.col(angle)), axial.folded(F.col(angle)) + 180.0)))
    counts = both.groupBy(*by, F.least(F.floor(F.col("_a") * n / 360.0), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*by)) if by else F.sum("c").over(Window.partitionBy(F.lit(0)))
    return counts.select(*by, "bin", (F.col("c") / total).alias("share"))


def geographic(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """df with geo_angle: angle180 turned from grid to true north by its scene's convergence."""
    found = df.join(scenes.select("scene_id", "convergence_deg", "crs"), "scene_id")
    return found.withColumn("geo_angle", axial.geographic(F.col("angle180"), F.col("convergence_deg"), F.col("crs"))).drop("convergence_deg", "crs")


def smoothed_ring_angles(df: DataFrame, res: float, smooth_px: float = 2.0, ring: str = "geometry") -> DataFrame:
    """df with raw_angle, raw_aspect, smooth_angle, smooth_aspect: fits before and after smoothing the outline around the ring.

    Rings of under 8 vertices, and failed second fits, keep the raw fit.
    """

    def both(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        raw = images.fit_ellipses(x, y, n)
        ends = np.cumsum(n)
        first, last = (ends - n)[n > 0], ends[n > 0] - 1
        closed = np.zeros(len(n), bool)
        closed[n > 0] = (x[first] == x[last]) & (y[first] == y[last])
        own = np.ones(len(x), bool)
        own[ends[closed] - 1] = False  # the closing vertex is no further one
        n = n - closed
        fit = images.fit_ellipses(images.smooth_rings(x[own], n, smooth_px), images.smooth_rings(y[own], n, smooth_px), n)
        done = (n >= 8) & ~np.isnan(fit[0])
        return [*raw, *(np.where(done, f, r) for f, r in zip(fit, raw, strict=True))]

    names = ["raw_angle", "raw_aspect", "smooth_angle", "smooth_aspect"]
    return _fitted(df, ring, res, names, both)


def grid_corrected_angles(dets: DataFrame, res: float, smooth_px: float = 2.0, n: int = 20_000, aspect_min: float = 1.0, seed: int = 0, key: str = "det_id") -> DataFrame:
    """Raw and smoothed angles of n sampled detections, those of aspect_min or more."""
    return smoothed_ring_angles(sample_n(dets, n, key, seed), res, smooth_px).where(F.col("smooth_aspect") >= aspect_min)
