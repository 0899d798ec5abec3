"""A PySpark-native spatial analytics engine."""
