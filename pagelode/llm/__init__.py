"""Operators for large-scale training-data preparation.

Nothing else in the package imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` binds them to the test tables.
"""
