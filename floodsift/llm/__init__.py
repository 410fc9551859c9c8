"""Operators over corpora of documents and vectors, for preparing training data."""
