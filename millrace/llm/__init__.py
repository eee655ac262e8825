"""Operators over corpora and postings for training data; nothing outside imports this subpackage."""
