"""lorekeep: a Spark-native document memory, retrieval and corpus administration engine."""

__version__ = "0.1.0"
