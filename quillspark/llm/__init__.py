"""Operators for large training-text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface and the thin ``opN_*`` query that derives the digest columns.
"""
