"""A Spark-first engine for corpus analytics."""
