"""Readers and writers of tables, record logs, tracks and archives."""
