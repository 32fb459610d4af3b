"""A Spark-native engine for network-structured, time-stamped energy-system data."""
