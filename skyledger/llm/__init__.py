"""Operators for training-data pipelines over documents.

Each module holds one operator with its own interface and, in ``queries``, the
registered query that applies it to whole tables. Nothing else in the library
imports this subpackage.
"""
