"""A Spark-first engine for library catalogues: record extraction, catalogue queries, status streams."""
