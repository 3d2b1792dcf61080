"""Text-cluster classification as Spark DataFrame operators."""
