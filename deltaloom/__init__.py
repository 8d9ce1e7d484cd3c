"""PySpark-native analytics for perturbation responses on sparse counts."""
