"""A PySpark-native engine for preparing and auditing training data."""
