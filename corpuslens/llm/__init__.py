"""Operators for preparing training corpora at scale.

Nothing else in the library imports this subpackage.  Every operator takes a
DataFrame and column names, returns a DataFrame, and is lazy unless its
docstring names a statistic that it has to gather first.
"""
