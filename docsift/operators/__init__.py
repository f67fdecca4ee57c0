"""Relational operators over the retrieval relations."""
