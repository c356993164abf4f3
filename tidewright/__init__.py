"""tidewright: a PySpark-native engine for batch file processing as data."""
