"""Operators of a training-data pipeline: deduplication, filtering, tokenisation, extraction.

Every operator takes DataFrames and returns DataFrames; ``queries`` holds the registered ones.
Nothing else in the library imports this package.
"""
