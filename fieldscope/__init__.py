"""fieldscope: a PySpark-native analytics engine for time-stamped channel data."""
