"""A PySpark-native statistical, portfolio and corpus analytics engine."""
