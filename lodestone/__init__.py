"""Lodestone: document evidence retrieval and corpus preparation as Spark DataFrame functions."""
