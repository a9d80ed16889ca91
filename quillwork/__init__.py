"""A Spark-native engine for analysing corpora of structured documents."""

__version__ = "0.1.0"
