"""liame: a Spark-native text-association analytics engine."""
