"""A Spark-native analytics engine over catalogs of related tables."""
