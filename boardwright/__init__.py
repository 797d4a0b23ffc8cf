"""boardwright: a PySpark-native engine for recruitment-notice and listing data."""
