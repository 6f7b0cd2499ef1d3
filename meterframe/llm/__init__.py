"""Operators for preparing training text (documents in, documents or per-document results out)."""
