"""Operators for the preparation of training corpora, each with its own query module."""
