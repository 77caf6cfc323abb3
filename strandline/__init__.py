"""Timeline, text and training-data operators for PySpark."""
