"""palimpsest: a Spark-native engine for time-stamped text memories."""

__version__ = "0.1.0"
