"""Tidemark: a Spark-native analytics engine for exchange filings."""
