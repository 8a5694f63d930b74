"""Data contracts as declarative Spark queries."""
