"""Operators of a training-data pipeline; see queries.py for how each is applied to the test tables."""
