"""Label files, annotation files and splits."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaxis.operators.datasets import ANNOTATIONS

SPLITS = ("train", "validation", "test")


def read_label_files(spark: SparkSession, root: str) -> DataFrame:
    """split, stem, text of root/<split>/labels/*.txt; empty files give no row, like missing ones."""
    files = spark.read.text(f"{root}/*/labels/*.txt", wholetext=True).withColumn("path", F.input_file_name())
    return files.select(F.regexp_extract("path", r"([^/]+)/labels/[^/]+$", 1).alias("split"), F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("stem"), F.col("value").alias("text"))


def write_label_files(labels: DataFrame, path: str) -> None:
    """Label texts (dataset, file_stem, text) as text files by dataset and stem; a run replaces what was there."""
    labels.select("dataset", "file_stem", "text").repartition("dataset", "file_stem").write.mode("overwrite").partitionBy("dataset", "file_stem").text(path)


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of an annotation file, one array or, without multi_line, an object a line: dataset, file_name, file_stem, annotations."""
    rows = spark.read.schema(f"dataset string, file_name string, annotations {ANNOTATIONS}").json(path, multiLine=multi_line)
    return rows.withColumn("file_stem", F.regexp_replace("file_name", r"\.png$", ""))


def split_images(images: DataFrame, split: str) -> DataFrame | None:
    """The images of one split; None if the split is absent, an error if its images are asked for by another name."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    found = images.where(F.col("split") == split)
    return None if found.isEmpty() else found


def required_images(images: DataFrame, split: str) -> DataFrame:
    found = split_images(images, split)
    if found is None:
        raise FileNotFoundError(f"no images in split {split}")
    return found
