"""terrafold: a PySpark-native spatial analytics engine."""
