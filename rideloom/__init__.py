"""rideloom: a PySpark-native analytics engine for event-driven mobility data."""
