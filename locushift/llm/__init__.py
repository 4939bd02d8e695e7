"""Corpus operators for training-data pipelines.

Nothing outside this folder imports it; ``catalog`` holds its queries and their SQL.
"""
