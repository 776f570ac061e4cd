"""Relational operators of the event study, each a function over DataFrames."""
