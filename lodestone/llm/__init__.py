"""Operators of a training-data pipeline over document tables."""
