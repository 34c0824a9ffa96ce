"""Tiles and windows of rasters.

A raster is a row of `scenes` (scene_id, width, height, transform a..f, res, crs, convergence_deg, footprint) and rows of
`blocks` (scene_id, block_row, block_col, h, w, pixels: uint8 bytes by rows) of one size. Windows are cut from blocks by
an equi-join on block numbers; the parts of a few windows at a time are put together in tasks. Tiles that cover a raster
are cut by strips: blocks go to the strip of tiles that they lie in, and only those of its rim to others. Outside is 0.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaxis.sources.stages import spread

STITCHED = 32
RAW_DETECTION = "scene_id long, tile_id long, x0 int, y0 int, sw int, sh int, local_id int, box struct<x1:double,y1:double,x2:double,y2:double>, score double, category_id int, mask struct<h:int,w:int,data:binary>"


def slice_offsets(full: Column, size: int, overlap: float) -> Column:
    """Starts of slices that cover 0..full: even steps, and a last one that ends at full."""
    step = F.greatest(F.bround(F.lit(size * (1 - overlap))).cast("int"), F.lit(1))
    even = F.sequence(F.lit(0), F.greatest(full - size, F.lit(0)), step)
    return F.when(full <= size, F.array(F.lit(0))).when(F.element_at(even, -1) == full - size, even).otherwise(F.concat(even, F.array((full - size).cast("int"))))


def tile_grid(scenes: DataFrame, size: int, overlap: float = 0.2) -> DataFrame:
    """scene_id, tile_id (row by row), x0, y0, sw, sh of overlapping tiles, cut at the scene's borders."""
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    offs = scenes.select("scene_id", "width", "height", slice_offsets(w, size, overlap).alias("xo"), slice_offsets(h, size, overlap).alias("yo"))
    rows = offs.select("*", F.posexplode("yo").alias("yi", "y0"))
    cells = rows.select("*", F.posexplode("xo").alias("xi", "x0"))
    return cells.select("scene_id", (F.col("yi") * F.size("xo") + F.col("xi")).cast("long").alias("tile_id"), "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).cast("int").alias("sw"), F.least(F.lit(size), F.col("height") - F.col("y0")).cast("int").alias("sh"))


def plain_grid(scenes: DataFrame, size: int, ragged_least: int | None = None) -> DataFrame:
    """Tiles without overlap: only full ones, or also border tiles of at least so many pixels each way."""
    last = lambda c: F.col(c) - (size if ragged_least is None else ragged_least)
    starts = lambda c: F.when(last(c) >= 0, F.sequence(F.lit(0), last(c).cast("int"), F.lit(size))).otherwise(F.array().cast("array<int>"))
    rows = scenes.select("scene_id", "width", "height", starts("width").alias("xo"), F.posexplode(starts("height")).alias("yi", "y0"))
    cells = rows.select("*", F.posexplode("xo").alias("xi", "x0"))
    return cells.select("scene_id", (F.col("yi") * F.size("xo") + F.col("xi")).cast("long").alias("tile_id"), "x0", "y0", F.least(F.lit(size), F.col("width") - F.col("x0")).cast("int").alias("sw"), F.least(F.lit(size), F.col("height") - F.col("y0")).cast("int").alias("sh"))


def read_windows(windows: DataFrame, blocks: DataFrame, block: int, key: str = "tile_id") -> DataFrame:
    """windows (scene_id, key, x0, y0, sw, sh) with pixels: uint8 bytes by rows, 0 outside the raster."""
    at = lambda v: F.floor(v / block).cast("int")
    span = lambda o, n: F.explode(F.sequence(at(F.col(o)), at(F.col(o) + F.col(n) - 1)))
    wanted = windows.select("scene_id", key, "x0", "y0", "sw", "sh").withColumn("block_row", span("y0", "sh")).withColumn("block_col", span("x0", "sw"))
    parts = wanted.join(blocks.select("scene_id", "block_row", "block_col", "h", "w", "pixels"), ["scene_id", "block_row", "block_col"], "left")
    kind = windows.schema[key].dataType.simpleString()

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        made: dict = {}
        for p in pdf.itertuples():
            name = (p.scene_id, p.key, p.x0, p.y0, p.sw, p.sh)
            out = made.get(name)
            if out is None:
                out = made[name] = np.zeros((int(p.sh), int(p.sw)), np.uint8)
            if p.pixels is not None and not pd.isna(p.h):
                data = np.frombuffer(p.pixels, np.uint8).reshape(int(p.h), int(p.w))
                y, x = p.block_row * block - p.y0, p.block_col * block - p.x0
                ya, xa = max(y, 0), max(x, 0)
                yb, xb = min(y + data.shape[0], out.shape[0]), min(x + data.shape[1], out.shape[1])
                if ya < yb and xa < xb:
                    out[ya:yb, xa:xb] = data[ya - y : yb - y, xa - x : xb - x]
        return pd.DataFrame([(*name, out.tobytes()) for name, out in made.items()], columns=["scene_id", key, "x0", "y0", "sw", "sh", "pixels"])

    # a group of STITCHED neighbours in the numbering costs a task little more than one window
    together = F.floor(F.col("key") / STITCHED) if isinstance(windows.schema[key].dataType, T.IntegralType) else F.xxhash64("key")
    grouped = spread(parts.withColumnRenamed(key, "key").withColumn("together", together), "scene_id", "together")
    return grouped.groupBy("scene_id", "together").applyInPandas(stitch, f"scene_id long, {key} {kind}, x0 int, y0 int, sw int, sh int, pixels binary")


def strip_side(block: int, size: int, step: int, pixels: int = 1 << 24) -> int:
    """The side of a strip, whole blocks long, whose canvas and whose tiles of a size and step each have about so many pixels at most."""
    side = int(pixels**0.5)
    return max(min(side - size, side * step // size) // block, 1) * block


def in_strips(blocks: DataFrame, block: int, size: int, side: int) -> DataFrame:
    """blocks with the strips (strip_row, strip_col) whose tiles may touch them: their own, and those just before them that reach over by a tile."""
    first = lambda c: F.greatest(F.floor((F.col(c) * block - size - side + 1) / side) + 1, F.lit(0).cast("long"))
    spread = lambda c: F.explode(F.sequence(first(c), F.floor((F.col(c) * block + block - 1) / side)))
    return blocks.withColumn("strip_row", spread("block_row")).withColumn("strip_col", spread("block_col"))


def read_grid(grid: DataFrame, blocks: DataFrame, block: int, size: int, step: int | None = None, side: int | None = None) -> DataFrame:
    """As read_windows(), for tiles of at most `size` that cover a raster: each goes to the strip that holds its corner.

    Strips are squares of `side` pixels. A block is shuffled once to its own strip, and again only if it lies in the rim of
    a tile's size beyond another one, so about (1 + size / side) ^ 2 times the raster moves, whatever the overlap.
    """
    side = side or strip_side(block, size, step or size)
    strip = ["scene_id", "strip_row", "strip_col"]
    at = lambda c: F.floor(F.col(c) / side)
    wanted = grid.select("scene_id", "tile_id", "x0", "y0", "sw", "sh").withColumns({"strip_row": at("y0"), "strip_col": at("x0")})
    parts = in_strips(blocks.select("scene_id", "block_row", "block_col", "h", "w", "pixels"), block, size, side)
    parts = parts.join(wanted.select(*strip).distinct(), strip, "left_semi")
    kind = grid.schema["scene_id"].dataType.simpleString()

    def stitch(windows: pa.Table, found: pa.Table) -> pa.Table:
        x0, y0, sw, sh = (windows.column(c).to_numpy().astype(np.int64) for c in ("x0", "y0", "sw", "sh"))
        top, left = (y0.min(), x0.min()) if len(x0) else (0, 0)
        canvas = np.zeros((int((y0 + sh).max() - top), int((x0 + sw).max() - left)) if len(x0) else (0, 0), np.uint8)
        for row, col, h, w, data in zip(*(found.column(c).to_pylist() for c in ("block_row", "block_col", "h", "w")), found.column("pixels"), strict=True):
            if None in (row, col, h, w) or not data.is_valid:
                continue
            y, x = row * block - top, col * block - left
            ya, xa, yb, xb = max(y, 0), max(x, 0), min(y + h, canvas.shape[0]), min(x + w, canvas.shape[1])
            if ya < yb and xa < xb:
                canvas[ya:yb, xa:xb] = np.frombuffer(data.as_buffer(), np.uint8).reshape(h, w)[ya - y : yb - y, xa - x : xb - x]
        cut = [canvas[y - top : y - top + h, x - left : x - left + w].tobytes() for x, y, w, h in zip(x0, y0, sw, sh, strict=True)]
        return windows.select(["scene_id", "tile_id", "x0", "y0", "sw", "sh"]).append_column("pixels", pa.array(cut, pa.binary()))

    return spread(wanted, *strip).groupBy(*strip).cogroup(spread(parts, *strip).groupBy(*strip)).applyInArrow(stitch, f"scene_id {kind}, tile_id {grid.schema['tile_id'].dataType.simpleString()}, x0 int, y0 int, sw int, sh int, pixels binary")


def tiles(scenes: DataFrame, blocks: DataFrame, block: int, size: int, overlap: float = 0.2) -> DataFrame:
    """All overlapping tiles of the scenes with their pixels."""
    return read_grid(tile_grid(scenes, size, overlap), blocks, block, size, max(round(size * (1 - overlap)), 1))


def random_windows(scenes: DataFrame, size: int, tries: int, seed: int = 0) -> DataFrame:
    """scene_id, try_id, x0, y0, sw, sh: corners drawn by the MD5 of "scene:try:seed:axis" (its first 60 bits), half-open at the far ends."""
    bits = lambda axis: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("scene_id").cast("string"), F.col("try_id").cast("string"), F.lit(seed), F.lit(axis))), 1, 15), 16, 10).cast("long")
    draw = lambda side, axis: (bits(axis) % (F.col(side) - size)).cast("int")
    each = scenes.where((F.col("width") > size) & (F.col("height") > size)).select("scene_id", "width", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tries - 1).cast("long"))).alias("try_id"))
    return each.select("scene_id", "try_id", draw("width", "x").alias("x0"), draw("height", "y").alias("y0"), F.lit(size).alias("sw"), F.lit(size).alias("sh"))


def valid_windows(scenes: DataFrame, blocks: DataFrame, block: int, size: int, n: int, valid_min: float = 0.95, std_min: float = 0.0, tries: int | None = None, seed: int = 0) -> DataFrame:
    """The first n random windows, by try_id, with enough non-zero pixels and deviation."""
    found = with_statistics(read_windows(random_windows(scenes, size, tries or 30 * n, seed), blocks, block, "try_id"))
    return found.where((F.col("valid") >= valid_min) & (F.col("std") >= std_min)).orderBy("try_id", "scene_id").limit(n)


def with_statistics(windows: DataFrame) -> DataFrame:
    """windows with valid (share of pixels over 0), std (population) and total of their pixels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a = [np.frombuffer(x, np.uint8) for x in pdf["pixels"]]
            yield pdf.assign(valid=[float((x > 0).mean()) for x in a], std=[float(x.std()) for x in a], total=[int(x.sum()) for x in a])

    return windows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in windows.dtypes) + ", valid double, std double, total long")


def centered_windows(points: DataFrame, scenes: DataFrame, size: int, contained: bool = False) -> DataFrame:
    """Windows of size x size around map points (scene_id, point_id, x, y); optionally only those inside the raster."""
    t = points.join(scenes.select("scene_id", "width", "height", "transform"), "scene_id")
    det = F.col("transform.a") * F.col("transform.e") - F.col("transform.b") * F.col("transform.d")
    dx, dy = F.col("x") - F.col("transform.c"), F.col("y") - F.col("transform.f")
    col, row = F.floor((F.col("transform.e") * dx - F.col("transform.b") * dy) / det), F.floor((F.col("transform.a") * dy - F.col("transform.d") * dx) / det)
    found = t.select("scene_id", "point_id", "width", "height", (col - size // 2).cast("int").alias("x0"), (row - size // 2).cast("int").alias("y0"), F.lit(size).alias("sw"), F.lit(size).alias("sh"))
    if contained:
        found = found.where((F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + size <= F.col("width")) & (F.col("y0") + size <= F.col("height")))
    return found.drop("width", "height")


def clamped_windows(points: DataFrame, scenes: DataFrame, half: int = 14) -> DataFrame:
    """Windows of half pixels to each side of pixel points (scene_id, point_id, cx, cy), cut at the borders, ends exclusive."""
    p = points.join(scenes.select("scene_id", "width", "height"), "scene_id")
    lo = lambda c: F.greatest(F.floor(F.col(c)) - half, F.lit(0)).cast("int")
    hi = lambda c, side: F.least(F.floor(F.col(c)) + half, F.col(side)).cast("int")
    return p.select("scene_id", "point_id", lo("cx").alias("x0"), lo("cy").alias("y0"), (hi("cx", "width") - lo("cx")).alias("sw"), (hi("cy", "height") - lo("cy")).alias("sh")).where("sw > 0 and sh > 0")


Predictor = Callable[[list[np.ndarray]], list[list[dict]]]


def detect(tiles_: DataFrame, predictor_factory: Callable[[], Predictor], batch_size: int = 8, min_score: float = 0.1, category: int | None = None, bands: int = 1, scale: float = 1.0) -> DataFrame:
    """Raw detections of tiles by the user's model, loaded once per task and called on batches.

    The model takes a list of images (h x w, or bands x h x w, times scale) and gives, per image, a list of dicts: box
    (x1, y1, x2, y2), score, category_id and mask (2-D). Scores of min_score and more stay, of one category if given.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = predictor_factory()
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                part = list(pdf.iloc[i : i + batch_size].itertuples())
                images = [np.frombuffer(t.pixels, np.uint8).reshape(t.sh, t.sw) * scale if scale != 1 else np.frombuffer(t.pixels, np.uint8).reshape(t.sh, t.sw) for t in part]
                images = [np.repeat(a[None], bands, 0) for a in images] if bands > 1 else images
                rows = []
                for t, found in zip(part, model(images), strict=True):
                    for j, d in enumerate(found):
                        if d["score"] >= min_score and (category is None or d["category_id"] == category):
                            m = np.asarray(d["mask"], np.float32)
                            rows.append((t.scene_id, t.tile_id, t.x0, t.y0, t.sw, t.sh, j, dict(zip(("x1", "y1", "x2", "y2"), map(float, d["box"]), strict=True)), float(d["score"]), int(d["category_id"]), {"h": m.shape[0], "w": m.shape[1], "data": m.tobytes()}))
                yield pd.DataFrame(rows, columns=["scene_id", "tile_id", "x0", "y0", "sw", "sh", "local_id", "box", "score", "category_id", "mask"])

    return tiles_.mapInPandas(run, RAW_DETECTION)


def threshold_predictor(level: int, min_pixels: int = 1) -> Callable[[], Predictor]:
    """A stand-in for a model: each connected part of pixels over a level is an object of category 1, scored by its mean."""
    from tessaxis.functions.images import components

    def factory() -> Predictor:
        def predict(images):
            out = []
            for image in images:
                a = image[0] if image.ndim == 3 else image
                label, n = components(a > level)
                found = []
                for i in range(1, n + 1):
                    m = label == i
                    ys, xs = np.nonzero(m)
                    if len(ys) >= min_pixels:
                        found.append({"box": (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1), "score": float(a[m].mean()) / 255, "category_id": 1, "mask": m})
                out.append(found)
            return out

        return predict

    return factory
