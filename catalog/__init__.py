"""Checkable queries: each operator on the given tables, beside its SQL twin."""
