"""Training-data operators: filtering, scoring, deduplication, tokenizing and sharding of text corpora.

Nothing outside this subpackage imports it.
"""
