"""tessaxis: detection, orientation and corpus analytics as Spark DataFrame operators."""
