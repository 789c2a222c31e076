"""cataloom: a PySpark-native engine for product catalogs, price history and click streams."""
