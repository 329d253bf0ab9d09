"""Invoice-document analytics as Spark DataFrame operators."""
