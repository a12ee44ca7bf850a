"""Search and analysis of large text corpora on Spark."""
