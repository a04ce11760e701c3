"""Store footfall and identity analytics as Spark DataFrame operators."""
