"""Readers and writers, and adapters from ordinary tables to events."""
