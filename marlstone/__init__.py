"""marlstone: Spark-native indexing, retrieval and quality gates for text and source knowledge."""

__version__ = "0.1.0"
