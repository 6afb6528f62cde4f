"""threadloom: a PySpark-native analytics engine for archives of assistant conversations."""
