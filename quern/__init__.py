"""quern: a Spark-native analytics engine (DataFrame, Catalyst, Structured Streaming)."""
