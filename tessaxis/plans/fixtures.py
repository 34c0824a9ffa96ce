"""Detection, angle, mask and patch tables that Spark derives from the benchmark tables by whole-number arithmetic."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaxis.functions import geometry
from tessaxis.sources.stages import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def square_mod(k: str, a: int, b: int, c: int, m: int) -> str:
    """SQL of (k * k * a + k * b + c) % m. Its products have no more bits than those of m, so no key is too large; below m the key itself counts, as the remainder has the sign of the sum."""
    small = f"(CASE WHEN {k} BETWEEN {1 - m} AND {m - 1} THEN {k} ELSE pmod({k}, {m}) END)"
    return f"({small} * {small} * {a} + {small} * {b} + {c}) % {m}"


def _boxes(rows: DataFrame) -> DataFrame:
    """Rows with key k: x0, y0, w, h, score, category_id, scene_id."""
    return rows.selectExpr(
        "*",
        "k div 4000 AS scene_id",
        f"cast({square_mod('k', 7919, 104729, 12345, 1000003)} AS double) / 1000003 * 2000 AS x0",
        f"cast({square_mod('k', 6007, 130363, 777, 1000003)} AS double) / 1000003 * 2000 AS y0",
        "cast(4 + (k % 21 * 31) % 21 AS double) AS w",
        "cast(4 + (k % 21 * 17) % 21 AS double) AS h",
        "0.05D + cast((k % 9001 * 48271) % 9001 AS double) / 10000 AS score",
        "cast(k % 3 AS int) AS category_id",
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, scene_id, score, category_id, bbox, geometry (the box's ring)."""
    rows = _boxes(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k"))
    found = rows.withColumn("bbox", geometry.box(F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")))
    return found.select(F.col("k").alias("det_id"), "scene_id", "score", "category_id", "bbox").withColumn("geometry", geometry.box_ring(F.col("bbox")))


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS det_id",
        "user_id",
        "event_type",
        f"""CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'purchase' THEN cast(125 + (event_id % 21 * 7) % 21 AS double)
           ELSE cast({square_mod('event_id', 7919, 31337, 99, 18000)} AS double) / 100 END AS angle180""",
        "1 + cast(event_id % 40 AS double) / 20 AS aspect_ra",
        "1 + cast(event_id % 23 AS double) / 2 AS diameter_m",
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, scene_id, x, y, area of reference objects near every seventh detection."""
    rows = _boxes(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_size", "7 * p_partkey + 1 AS k"))
    return rows.selectExpr("id", "scene_id", "x0 + (cast(id % 5 AS double) - 2) * 0.5 AS x", "y0 + (cast(id % 5 AS double) - 2) * 0.5 AS y", "pi() * (4 + p_size % 12) * (4 + p_size % 12) / 4 AS area")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, scene_id, x, y, area of detections by the lower left corner."""
    b = F.col("bbox")
    return detections(spark, sf_dir).select(F.col("det_id").alias("id"), "scene_id", b["xmin"].alias("x"), b["ymin"].alias("y"), ((b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])).alias("area"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, mh, mw: sides of rectangular masks."""
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").selectExpr("c_custkey AS det_id", "cast(3 + c_custkey % 9 AS int) AS mh", "cast(3 + c_custkey % 7 AS int) AS mw")


def mask_pixels(spark: SparkSession, sf_dir: str, soft: bool = True) -> DataFrame:
    """det_id, row, col, w: rectangles, of weight 0.5 at the border if soft."""
    r = rectangles(spark, sf_dir).selectExpr("*", "explode(sequence(0, mh - 1)) AS row").selectExpr("*", "explode(sequence(0, mw - 1)) AS col")
    border = "row = 0 OR col = 0 OR row = mh - 1 OR col = mw - 1"
    return r.selectExpr("det_id", "row", "col", f"CASE WHEN {border} THEN 0.5D ELSE 1.0D END AS w" if soft else "1.0D AS w")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, mask: the rectangles with a frame of one empty pixel."""
    import numpy as np
    import pandas as pd

    from tessaxis.operators.masks import MASK, to_mask

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"det_id": pdf["det_id"], "mask": [to_mask(np.pad(np.ones((h, w)), 1)) for h, w in zip(pdf["mh"], pdf["mw"], strict=True)]})

    return rectangles(spark, sf_dir).mapInPandas(run, f"det_id long, mask {MASK}")


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, label, n, pixels: the 64 values of each vector as 8 x 8."""
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "vec_id").selectExpr("vec_id AS patch_id", "label", "8 AS n", "transform(embedding, v -> cast(v AS double)) AS pixels")


BLOCK, BLOCKS_A_ROW = 8, 16


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raster of 8 x 8 blocks, 16 a row: pixels are 128 + 100 times the vectors' values, rounded, in 0..255."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            values = np.array(pdf["embedding"].tolist(), float).reshape(len(pdf), -1)
            made = np.clip(np.floor(128 + 100 * values + 0.5), 0, 255).astype(np.uint8)
            yield pd.DataFrame({"scene_id": 0, "block_row": pdf["vec_id"] // BLOCKS_A_ROW, "block_col": pdf["vec_id"] % BLOCKS_A_ROW, "h": BLOCK, "w": BLOCK, "pixels": [x.tobytes() for x in made]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "scene_id long, block_row int, block_col int, h int, w int, pixels binary")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's scene: pixels of 2 map units, origin (1000, 5000); blocks that its last row lacks are 0."""
    size = table(spark, sf_dir, "embeddings").selectExpr("cast((count(*) + 15) div 16 * 8 AS int) AS height")
    return size.selectExpr(
        "0L AS scene_id", "128 AS width", "height",
        "named_struct('a', 2.0D, 'b', 0.0D, 'c', 1000.0D, 'd', 0.0D, 'e', -2.0D, 'f', 5000.0D) AS transform",
        "2.0D AS res", "'+proj=sinu' AS crs", "1.5D AS convergence_deg",
    )


PIECE = 8


def piece_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster's blocks as scenes of PIECE block rows each."""
    b = blocks(spark, sf_dir)
    return b.withColumn("scene_id", F.floor(F.col("block_row") / PIECE)).withColumn("block_row", (F.col("block_row") % PIECE).cast("int"))


def piece_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of piece_blocks, at their places on the raster's map; every second one has twice the res."""
    side = PIECE * BLOCK
    each = scenes(spark, sf_dir).where("height > 0").withColumn("scene_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("height") - 1) / side))))
    each = each.withColumn("res", 2.0 + 2.0 * (F.col("scene_id") % 2)).withColumn("transform", F.struct(F.col("res").alias("a"), F.lit(0.0).alias("b"), F.lit(1000.0).alias("c"), F.lit(0.0).alias("d"), (-F.col("res")).alias("e"), (5000.0 - 2 * side * F.col("scene_id")).alias("f")))
    return each.withColumn("height", F.least(F.lit(side), F.col("height") - side * F.col("scene_id")).cast("int"))


BLOB_BLOCK, BLOBS_A_ROW = 16, 16


def blob_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rasters of 16 x 16 blocks, 16 a row: each customer is a block with one rectangle of one brightness on black."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            made = np.zeros((len(pdf), BLOB_BLOCK, BLOB_BLOCK), np.uint8)
            for a, x, y, w, h, v in zip(made, *(pdf[c] for c in ("x", "y", "w", "h", "v")), strict=True):
                a[y : y + h, x : x + w] = v
            yield pdf[["scene_id", "block_row", "block_col"]].assign(h=BLOB_BLOCK, w=BLOB_BLOCK, pixels=[a.tobytes() for a in made])

    rows = spread(table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS long) AS k"), "k").selectExpr(
        "k % 3 AS scene_id", f"cast(k div 3 div {BLOBS_A_ROW} AS int) AS block_row", f"cast(k div 3 % {BLOBS_A_ROW} AS int) AS block_col",
        "cast(2 + 7 * k % 3 AS int) AS x", "cast(2 + k % 4 AS int) AS y", "cast(4 + k % 5 AS int) AS w", "cast(3 + k div 5 % 7 AS int) AS h", "cast(160 + 13 * k % 90 AS int) AS v",
    )
    return rows.mapInPandas(run, "scene_id long, block_row int, block_col int, h int, w int, pixels binary")


def blob_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenes of blob_blocks: pixels of 2 map units, origin (1000, 5000), with footprints."""
    size = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS long) AS k").groupBy(F.expr("k % 3").alias("scene_id")).agg(F.expr(f"cast((max(k div 3) div {BLOBS_A_ROW} + 1) * {BLOB_BLOCK} AS int)").alias("height"))
    each = size.selectExpr(
        "scene_id", f"{BLOB_BLOCK * BLOBS_A_ROW} AS width", "height", "2.0D AS res",
        "named_struct('a', 2.0D, 'b', 0.0D, 'c', 1000.0D, 'd', 0.0D, 'e', -2.0D, 'f', 5000.0D) AS transform",
    )
    return each.withColumn("footprint", geometry.box_ring(geometry.box(F.lit(1000.0), 5000 - 2.0 * F.col("height"), 1000 + 2.0 * F.col("width"), F.lit(5000.0))))


def grid_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of many sizes, one a customer."""
    return table(spark, sf_dir, "customer").selectExpr("cast(c_custkey AS long) AS scene_id", "cast(300 + 97 * (c_custkey % 25) AS int) AS width", "cast(250 + 61 * (c_custkey % 25) AS int) AS height")


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """phi0, alpha, raw_peak by part."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(15 * (p_partkey % 12) AS double) AS phi0", "cast(10 * (p_partkey % 18) AS double) AS alpha", "cast(pmod(135 - 10 * (p_partkey % 18) * (p_partkey % 2) + p_partkey % 3, 180) AS double) AS raw_peak")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patch_id, label, bin, center_deg, value: the first 36 values of each vector as a profile."""
    each = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS patch_id", "label", "posexplode(slice(embedding, 1, 36)) AS (bin, v)")
    return each.selectExpr("patch_id", "label", "bin", "(bin + 0.5D) * 5 AS center_deg", "1 + cast(v AS double) AS value")


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, image_id, width, height, text: two rectangles, a short line and a stray value by document."""
    return table(spark, sf_dir, "documents").selectExpr(
        "CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split", "doc_id AS image_id", "64 AS width", "48 AS height",
        """concat_ws('\\n', concat_ws(' ', '0', 0.125, 0.25, 0.125 + 0.0625 * (doc_id % 5), 0.25, 0.125 + 0.0625 * (doc_id % 5), 0.25 + 0.125 * (doc_id % 4), 0.125, 0.25 + 0.125 * (doc_id % 4)),
           '0 0.1 0.2 0.3', concat_ws(' ', '0', 0.5, 0.5, 0.75, 0.5, 0.75, 0.875, 0.5, 0.875, 0.125)) AS text""",
    )
