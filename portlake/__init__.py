"""Maritime observation tables and cross-domain evaluation as Spark DataFrame operators."""
