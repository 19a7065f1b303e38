"""Operators for preparing language-model training data (see the README).

Every operator takes DataFrames and column names, selects only the columns it
needs (extra columns, also with clashing names, are ignored) and returns a
DataFrame with a schema of its own.  Nothing else in the library imports this
sub-package.
"""
