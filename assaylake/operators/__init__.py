"""Operators over evaluation, ledger and retrieval relations."""
