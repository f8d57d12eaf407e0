"""Training-data operators: deduplication, tokenisation, packing and scoring of text corpora.

Nothing outside this package imports it.
"""
