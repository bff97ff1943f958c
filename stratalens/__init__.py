"""stratalens: a Spark-first analytics engine for source code and text corpora."""
