"""Streams give what batches give."""

from tests.conftest import SF
from tessaxis.plans import fixtures as fx
from tessaxis.streaming.histograms import running_counts


def test_running_counts(spark, tmp_path):
    angles = fx.angles(spark, SF).select("event_type", "angle180")
    angles.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(angles.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_counts(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("running").collect()) == sorted(running_counts(angles, ["event_type"]).collect())
