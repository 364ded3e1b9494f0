"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_*`` queries and their SQL, every other module one operator.
"""
