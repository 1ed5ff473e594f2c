"""A PySpark-native engine for raster, vector and table analytics."""
