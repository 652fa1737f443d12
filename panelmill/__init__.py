"""PySpark-native engine for zone-by-hour demand panels."""
