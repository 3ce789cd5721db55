"""A Spark-first retrieval and document-analytics engine."""

__version__ = "0.1.0"
