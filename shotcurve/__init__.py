"""Few-shot learning-curve analytics as Spark DataFrame operators."""
