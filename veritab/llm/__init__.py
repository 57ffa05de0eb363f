"""Operators of a training-data pipeline over document, embedding and benchmark tables."""
