"""Spark-native ranking, grouping and selection of large media collections."""
