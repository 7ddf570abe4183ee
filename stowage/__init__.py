"""Store-trace analytics on Spark."""
