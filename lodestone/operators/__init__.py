"""Relational operators that rules need beyond what DataFrames offer."""
