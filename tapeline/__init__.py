"""A PySpark-native engine for narrative indices and corpus preparation."""
