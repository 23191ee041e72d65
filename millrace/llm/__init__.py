"""Operators of a large-scale training-data pipeline.

Every operator reads only the columns it names (`doc_id`, `text`), so extra columns, whatever
their names, never clash.  A null text counts as an empty text.  A document is known by
(doc_id, hash of its text): rows repeated with both equal get equal results, rows that share a
doc_id but not the text are scored apart, and a null doc_id is a value like any other.
"""
