"""Orientation of image texture by the structure tensor. Patches are (patch_id, n, pixels ARRAY<DOUBLE> by rows)."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaxis.functions import axial, images
from tessaxis.sources.stages import merged, spread, written


def _columns(df: DataFrame, drop: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes if n not in drop)


def tensor_orientations(patches: DataFrame, smooth: float = 1.0, sigma: str | None = None) -> DataFrame:
    """patches (without pixels) with az and coh; `sigma` names a column of centered Gaussian weights' widths in pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums = []
            for row in pdf.to_dict("records"):
                a = np.asarray(row["pixels"], float).reshape(row["n"], -1)
                weight = None
                if sigma:
                    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
                    weight = np.exp(-((y - a.shape[0] / 2) ** 2 + (x - a.shape[1] / 2) ** 2) / (2 * row[sigma] ** 2))
                sums.append(images.structure_tensor(a, weight, smooth))
            out = pdf.drop(columns="pixels")
            out[["jxx", "jyy", "jxy"]] = sums if sums else np.zeros((0, 3))
            yield out

    found = patches.mapInPandas(run, _columns(patches, ("pixels",)) + ", jxx double, jyy double, jxy double")
    spread = F.hypot(F.col("jxx") - F.col("jyy"), 2 * F.col("jxy"))
    low = (F.col("jxx") + F.col("jyy") - spread) / 2
    # the axis of least change: (Jxy, low - Jxx) in east and south
    flat = (F.col("jxy") == 0) & (low == F.col("jxx"))
    az = F.when(flat, F.lit(90.0)).otherwise(axial.azimuth(F.col("jxy"), F.col("jxx") - low))
    return found.withColumn("az", az).withColumn("coh", spread / (F.col("jxx") + F.col("jyy") + 1e-12)).drop("jxx", "jyy", "jxy")


def halo(grad_sigma: float, integ_sigma: float) -> int:
    """Pixels around a tile that its orientation field depends on."""
    return int(4 * grad_sigma + 0.5) + 1 + int(4 * integ_sigma + 0.5)


def orientation_field(windows: DataFrame, grad_sigma: float = 1.0, integ_sigma: float = 4.0, margin: int = 0, key: str = "tile_id") -> DataFrame:
    """key, row, col (in the raster), az, coh, value of each pixel of windows (x0, y0, sw, sh, pixels), without their margin.

    Read tiles with margin = halo(...) to get the same field as of the whole raster.
    """
    kind = windows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w in pdf.to_dict("records"):
                a = np.frombuffer(w["pixels"], np.uint8).reshape(w["sh"], w["sw"])
                az, coh = images.orientation_field(a, grad_sigma, integ_sigma)
                inner = np.s_[margin : w["sh"] - margin, margin : w["sw"] - margin]
                y, x = np.mgrid[inner]
                yield pd.DataFrame({key: w[key], "row": (y + w["y0"]).ravel(), "col": (x + w["x0"]).ravel(), "az": az[inner].ravel(), "coh": coh[inner].ravel(), "value": a[inner].ravel().astype("int32")})

    return windows.mapInPandas(run, f"{key} {kind}, row int, col int, az double, coh double, value int")


def object_texture(dets: DataFrame, patches: DataFrame, res: float, aspect_min: float = 1.35, smooth: float = 1.0, on: str = "det_id") -> DataFrame:
    """Mask angle against structure-tensor angle per object: det_id, mask_ang, aspect, diameter_m, st_ang, st_coh.

    dets: det_id, angle180, aspect_ra, diameter_m, bbox; patches: det_id, n, pixels around each object's center, or with
    `on` another key that dets have too. The tensor of a patch is computed once for each width of its weights.
    """
    radius = F.greatest(F.col("bbox.xmax") - F.col("bbox.xmin"), F.col("bbox.ymax") - F.col("bbox.ymin")) / 2
    kept = dets.where(F.col("aspect_ra") >= aspect_min).withColumn("sigma", F.greatest(radius / res, F.lit(2.0)))
    asked = spread(kept.select(on, "sigma").distinct().join(merged(patches.where("n >= 7")), on).select(on, "sigma", "n", "pixels"), on, "sigma")
    found = written(tensor_orientations(asked, smooth, "sigma").select(on, "sigma", "az", "coh"))
    return kept.join(merged(found), [on, "sigma"]).select("det_id", F.col("angle180").alias("mask_ang"), F.col("aspect_ra").alias("aspect"), "diameter_m", F.col("az").alias("st_ang"), F.col("coh").alias("st_coh"))


def regional_histogram(crops: DataFrame, scales: list[tuple[float, float]], coherent_share: float = 0.25, bin_deg: int = 10) -> DataFrame:
    """Mean over crops (sh, sw, pixels) of their coherence-weighted azimuth histograms in percent: scale, bin, center_deg, percent.

    In each crop and scale only the most coherent pixels that are not 0 count; the threshold is over all its pixels. Crops
    without such pixels do not count. A crop's field is made and summed in one task, which hands on a number for each bin.
    """
    n = 180 // bin_deg

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for pixels, h in zip(pdf["pixels"], pdf["sh"], strict=True):
                a = np.frombuffer(pixels, np.uint8).reshape(h, -1)
                for i, (g, s) in enumerate(scales):
                    az, coh = images.orientation_field(a, g, s)
                    kept = (coh >= np.percentile(coh, 100 * (1 - coherent_share))) & (a > 0)
                    sums = np.bincount(np.minimum(az[kept] // bin_deg, n - 1).astype(int), coh[kept], n)
                    if sums.sum() > 0:
                        rows.append((i, 100 * sums / sums.sum()))
            yield pd.DataFrame(rows, columns=["scale", "percents"])

    each = crops.select("sh", "pixels").mapInPandas(run, "scale int, percents array<double>")
    long = each.select("scale", F.posexplode("percents").alias("bin", "percent"))
    return long.groupBy("scale", F.col("bin").cast("long").alias("bin")).agg(F.avg("percent").alias("percent")).select("scale", "bin", ((F.col("bin") + 0.5) * bin_deg).alias("center_deg"), "percent")
