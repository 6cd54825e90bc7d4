"""A PySpark-native analytics engine for multilingual document evidence."""
