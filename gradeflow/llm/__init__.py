"""Operators for large-scale text corpora: one module per operator, queries in ``queries``.

Nothing else in the library imports this package.  Every operator takes and returns DataFrames and
works on whole texts.  Columns of the input are read by name through parameters; helper columns are
kept apart from them, so inputs may carry further columns of any name.
"""
