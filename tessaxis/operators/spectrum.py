"""Angular power spectra of patch tables (patch_id, n, pixels ARRAY<DOUBLE> by rows), their contrasts and control jobs."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaxis.functions import axial, images
from tessaxis.operators import tiles
from tessaxis.sources.stages import written


def frequency_grid(spark, n: int) -> DataFrame:
    """row, col, radius (cycles a pixel) and azimuth of the centered FFT plane."""
    f = lambda c: (F.col(c) - n // 2) / F.lit(float(n))
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).alias("row"), (F.col("id") % n).alias("col"))
    return grid.withColumn("radius", F.hypot(f("col"), f("row"))).withColumn("azimuth", axial.azimuth(f("col"), -f("row")))


def profiles(patches: DataFrame, by: list[str] = ("patch_id",), band: tuple[float, float] = (2.5, 8.0), nbins: int = 36, detrend_sigma: float | None = None) -> DataFrame:
    """Angular power profile of each patch in units of its mean: by, bin, center_deg, value; empty bins are null."""
    by = list(by)
    schema = ", ".join(f"{c} {patches.schema[c].dataType.simpleString()}" for c in by) + ", bin int, center_deg double, value double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [images.angular_profile(np.asarray(x, float).reshape(n, -1), band, nbins, detrend_sigma) for x, n in zip(pdf["pixels"], pdf["n"], strict=True)]
            value = np.concatenate(made) if made else np.zeros(0)
            out = pdf[by].loc[pdf.index.repeat(nbins)].reset_index(drop=True)
            out["bin"] = np.tile(np.arange(nbins), len(pdf))
            out["center_deg"] = (out["bin"] + 0.5) * 180 / nbins
            out["value"] = pd.arrays.FloatingArray(np.where(np.isnan(value), 0, value), np.isnan(value))
            yield out[[*by, "bin", "center_deg", "value"]]

    return patches.mapInPandas(run, schema)


def ensemble(profiles_: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean profile over patches: by, bin, center_deg, value."""
    return profiles_.groupBy(*by, "bin", "center_deg").agg(F.avg("value").alias("value"))


#: The first probabilities, summed, of the Poisson distribution of mean 1.
POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759, 0.999989751]


def bootstrap_band(profiles_: DataFrame, n_boot: int = 400, ci: tuple[float, float] = (2.5, 97.5), seed: int = 0) -> DataFrame:
    """Mean profile with percentiles of its resamples over patches: bin, center_deg, value, lo, hi.

    How often a patch is in a resample is a Poisson draw by a hash, the limit of drawing with replacement for many
    patches; so no task needs to number or count all patches.
    """
    u = F.pmod(F.xxhash64("patch_id", "boot", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    times = F.lit(len(POISSON))
    for i, p in reversed(list(enumerate(POISSON))):
        times = F.when(u < p, F.lit(i)).otherwise(times)
    rows = profiles_.where(F.col("value").isNotNull()).withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("m", times)
    means = rows.groupBy("boot", "bin").agg(F.try_divide(F.sum(F.col("m") * F.col("value")), F.sum("m")).alias("v"))
    band = means.groupBy("bin").agg(F.percentile("v", F.array(F.lit(ci[0] / 100), F.lit(ci[1] / 100))).alias("q"))
    return ensemble(profiles_).join(band, "bin").select("bin", "center_deg", "value", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def contrast(axes: tuple[float, ...], tol: float = 10.0, center: Column | None = None, value: Column | None = None) -> Column:
    """Aggregate: mean value of the bins near the axes, over that of the others, minus 1."""
    c, v = F.col("center_deg") if center is None else center, F.col("value") if value is None else value
    near = axial.distance(c, axes[0]) <= tol
    for a in axes[1:]:
        near = near | (axial.distance(c, a) <= tol)
    return F.try_divide(F.avg(F.when(near, v)), F.avg(F.when(~near, v))) - 1


def summary(profile: DataFrame, by: list[str] = (), tol: float = 10.0) -> DataFrame:
    """Contrasts of the diagonals, the cardinals and each axis, peak and trough bins, and modulation, per group."""
    v = F.col("value")
    named = {"diag_contrast": (45.0, 135.0), "card_contrast": (0.0, 90.0)} | {f"c{a}": (float(a),) for a in (0, 45, 90, 135)}
    return profile.groupBy(*by).agg(
        *(contrast(axes, tol).alias(n) for n, axes in named.items()),
        F.max_by("center_deg", F.struct(v, -F.col("bin"))).alias("peak_deg"),
        F.min_by("center_deg", F.struct(F.coalesce(v, F.lit(float("inf"))), F.col("bin"))).alias("trough_deg"),
        F.try_divide(F.max(v) - F.min(v), F.avg(v)).alias("modulation"),
    )


def _per_patch(patches: DataFrame, run_row: Callable, parameters: DataFrame) -> DataFrame:
    """Every patch with every row of parameters (a small table), its pixels replaced by run_row(pixels, row)."""
    both = patches.crossJoin(F.broadcast(parameters))
    names = both.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            made = [run_row(np.asarray(r["pixels"], float).reshape(r["n"], -1), r) for r in rows]
            yield pdf.assign(pixels=[m.ravel() for m in made], n=[m.shape[0] for m in made])[names]

    return both.mapInPandas(run, both.schema)


def blurred(patches: DataFrame, parameters: DataFrame) -> DataFrame:
    """Patches blurred along each (sigma, angle_deg): the injection control."""
    return _per_patch(patches, lambda a, r: images.directional_blur(a, r["sigma"], r["angle_deg"]), parameters)


def surrogates(patches: DataFrame, seeds: DataFrame, quantize: bool = True) -> DataFrame:
    """Phase-randomised patches for each seed: the null ensemble."""
    return _per_patch(patches, lambda a, r: images.isotropic_surrogate(a, [int(r["seed"]), int(r["patch_id"])], quantize), seeds)


def warped(patches: DataFrame, parameters: DataFrame) -> DataFrame:
    """Patches turned by each (angle_deg, kernel), central half: the resampling control."""
    return _per_patch(patches, lambda a, r: images.warp_rotate(a, r["angle_deg"], r["kernel"]), parameters)


def control_summaries(made: DataFrame, by: list[str], band: tuple[float, float] = (2.5, 8.0), nbins: int = 36, tol: float = 10.0) -> DataFrame:
    """A control job's mean profiles by parameter, summarised."""
    return summary(ensemble(written(profiles(made, [*by, "patch_id"], band, nbins)), by), by, tol)


# The tests of flat patches in order, and the order of their reasons.
REASONS = ["valid", "boulder", "std", "shadow", "outlier", "coherence"]


def screened(windows: DataFrame, objects: DataFrame, cell: float, buffer: float = 0.0, valid_min: float = 0.999, std_min: float = 1.5, shadow_dn: int = 20, shadow_max: float = 0.005, outlier_z: float = 4.0, outlier_max: float = 0.002, coherence_max: float = 0.35) -> DataFrame:
    """Windows (scene_id, try_id, box, n, x0, y0, sw, sh, pixels) with reason: the first test that fails, or null for flat ones."""
    from tessaxis.operators.spatial import without_objects

    wide = windows.withColumn("box", F.struct(*((F.col(f"box.{c}") + s * buffer).alias(c) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1)))))
    free = without_objects(wide.select("scene_id", "try_id", "box"), objects, cell).select("scene_id", "try_id", F.lit(True).alias("_free"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, h in zip(pdf["pixels"], pdf["sh"], strict=True):
                a = np.frombuffer(x, np.uint8).reshape(h, -1).astype(float)
                high = a - images.gaussian(a, len(a) / 8)
                jxx, jyy, jxy = images.structure_tensor(a)
                rows.append(((a > 0).mean(), a.std(), (a < shadow_dn).mean(), (np.abs(high) > outlier_z * high.std()).mean(), np.hypot(jxx - jyy, 2 * jxy) / (jxx + jyy + 1e-12)))
            out = pdf.copy()
            out[["valid", "std", "shadow", "outlier", "coherence"]] = rows if rows else np.zeros((0, 5))
            yield out

    stats = windows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in windows.dtypes) + ", valid double, std double, shadow double, outlier double, coherence double")
    failed = {"valid": F.col("valid") < valid_min, "boulder": F.col("_free").isNull(), "std": F.col("std") < std_min, "shadow": F.col("shadow") > shadow_max, "outlier": F.col("outlier") > outlier_max, "coherence": F.col("coherence") > coherence_max}
    reason = F.lit(None).cast("string")
    for name in reversed(REASONS):
        reason = F.when(failed[name], F.lit(name)).otherwise(reason)
    return stats.join(free, ["scene_id", "try_id"], "left").withColumn("reason", reason).drop("_free")


def flat_patches(screened_: DataFrame, n: int) -> DataFrame:
    """The first n accepted windows by try_id."""
    return screened_.where("reason IS NULL").orderBy("try_id", "scene_id").limit(n)


def reject_counts(screened_: DataFrame, n: int) -> DataFrame:
    """Rejects by reason among the tries up to the one that filled the quota of n: reason, c."""
    last = flat_patches(screened_, n).agg(F.count("*").alias("k"), F.max("try_id").alias("last"))
    seen = screened_.crossJoin(F.broadcast(last)).where((F.col("k") < n) | (F.col("try_id") <= F.col("last")))
    return seen.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("c"))


def object_patches(dets: DataFrame, scenes: DataFrame, blocks: DataFrame, block: int, size: int, n: int, diameter_px: tuple[float, float] = (4, 16), valid_min: float = 0.999, seed: int = 0) -> DataFrame:
    """Patches centered on n objects of fitting size whose windows lie inside the raster and are valid.

    4 * n objects are drawn by hash first; dets: det_id, scene_id, center, diameter_m.
    """
    drawn = dets.orderBy(F.xxhash64("det_id", F.lit(seed)), "det_id").limit(4 * n)
    sized = drawn.join(scenes.select("scene_id", "res"), "scene_id").where((F.col("diameter_m") / F.col("res")).between(*diameter_px))
    points = sized.select("scene_id", F.col("det_id").alias("point_id"), F.col("center.x").alias("x"), F.col("center.y").alias("y"))
    found = tiles.read_windows(tiles.centered_windows(points, scenes, size, contained=True), blocks, block, "point_id")
    return tiles.with_statistics(found).where(F.col("valid") >= valid_min).orderBy("point_id").limit(n)


def as_patches(windows: DataFrame, key: str) -> DataFrame:
    """Windows as patches: patch_id, n, pixels ARRAY<DOUBLE>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"patch_id": pdf[key], "n": pdf["sh"], "pixels": [np.frombuffer(x, np.uint8).astype(float) for x in pdf["pixels"]]})

    return windows.mapInPandas(run, "patch_id long, n int, pixels array<double>")

