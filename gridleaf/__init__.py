"""Spark engine for semi-structured form documents and prediction scoring."""
