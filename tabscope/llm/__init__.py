"""Operators of a training-data pipeline over text, embedding and label tables.

Nothing else in the library imports this package; ``queries`` holds the registered
queries, ``corpus_pipeline.py`` at the repository top chains five of the operators.
"""
