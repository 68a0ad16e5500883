"""Registered queries: each module has ``QUERIES`` and, where SQL can express the operator, ``SQL``."""

MODULES = ["copies", "pages", "changes", "workflow", "revisions", "sync"]
