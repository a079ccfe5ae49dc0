"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general ``DataFrame -> DataFrame`` interface; ``queries`` binds
them to the tables.
"""
