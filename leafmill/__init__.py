"""leafmill: a Spark-native engine for a library of saved documents."""
