"""Readers of documents and lists, and writers of twins and reports."""
