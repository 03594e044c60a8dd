"""codelode: Spark-native retrieval, graph and corpus analytics over source code."""

__version__ = "0.1.0"
