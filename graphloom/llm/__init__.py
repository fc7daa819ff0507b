"""Training-data operators.

Nothing outside this subpackage imports it; removing the folder leaves the
rest of the library working.  Every operator takes and returns DataFrames and
states its behaviour for nulls, empty texts, ties and repeated rows in its
docstring.  ``queries.py`` holds the registered queries.
"""
