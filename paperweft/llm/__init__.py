"""Operators of a training-data pipeline on a documents table (doc_id, text, lang, source, n_chars)."""
