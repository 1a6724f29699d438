"""Operators of a training-data pipeline over large document, page and vector
tables.  Nothing outside this package imports it (the registered queries are
added by ``__spark_entry__.py`` when it is present)."""
