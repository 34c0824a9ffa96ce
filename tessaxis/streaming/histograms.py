"""Running orientation counts over a stream of detections."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaxis.functions import axial


def running_counts(stream: DataFrame, by: list[str], nbins: int = 180) -> DataFrame:
    """by, bin, n of a stream with angle180: state of at most nbins rows a group; write it in complete or update mode."""
    bin_ = F.least(F.floor(axial.folded(F.col("angle180")) * nbins / 180.0), F.lit(nbins - 1))
    return stream.where(F.col("angle180").isNotNull()).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"))
