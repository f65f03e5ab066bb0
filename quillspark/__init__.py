"""quillspark: a PySpark-native engine for records, evidence and laboratory data."""
