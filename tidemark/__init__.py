"""tidemark: a Spark-first engine for windowed signals and leak-free, group-level model evaluation."""
