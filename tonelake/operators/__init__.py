"""Relational operators that DataFrames do not have themselves."""
