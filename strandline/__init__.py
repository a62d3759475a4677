"""Tracking of live text against a corpus, and training-data operators, on Spark."""
