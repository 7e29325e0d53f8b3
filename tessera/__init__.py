"""Spark-native curation engine: DataFrame-to-DataFrame operators for per-entity record collections."""
