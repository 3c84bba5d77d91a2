"""morphlake: a PySpark-native text-analytics engine."""
