"""verdancy: gridded-observation analytics as Spark DataFrame operators."""
