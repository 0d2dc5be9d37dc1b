"""Training-data operators: cleaning, deduplication, mixing and output of text corpora.

Nothing else in the library imports this subpackage; ``queries.py`` lists its
queries and DuckDB statements for ``__spark_entry__.py``.
"""
