"""Connected components of edge tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaxis.sources.stages import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the least node that edges (a, b) reach. Each round's labels are a table in the shared folder.

    In a round each component takes the least label that one of its nodes sees, and jumps to that one's own; so labels
    move by whole components, and long chains need few rounds.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        roots = low.groupBy("was").agg(F.min("low").alias("low"))
        to = roots.join(roots.select(F.col("was").alias("low"), F.col("low").alias("lower")), "low", "left").select("was", F.coalesce("lower", "low").alias("comp"))
        last, new = labels, written(low.join(to, "was").select("node", "was", "comp"))
        dropped(last)
        labels = new.select("node", "comp")
        if new.where("was <> comp").isEmpty():
            dropped(both)
            return labels
