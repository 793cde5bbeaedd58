"""A Spark-native engine for provenance-tracked entity and link data."""
