"""Training-data operators: encoding, deduplication, filtering and scoring of documents.

Nothing else in the library imports this subpackage.
"""
