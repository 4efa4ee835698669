"""glossa: a Spark-native engine for text statistics, cross-lingual subspaces and sequence tagging."""
