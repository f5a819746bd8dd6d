"""Training-data operators: scoring, extraction, deduplication, tokenizing and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
