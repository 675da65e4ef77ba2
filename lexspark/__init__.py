"""lexspark: Spark-native preparation, profiling and scoring of legal-text corpora."""

__version__ = "0.1.0"
