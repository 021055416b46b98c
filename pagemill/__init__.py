"""pagemill: a PySpark-native engine for document analytics."""
