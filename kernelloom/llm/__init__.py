"""Training-data operators: deduplication, search, mixing, filtering and file formats.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames;
``queries`` holds the thin registered queries.
"""
