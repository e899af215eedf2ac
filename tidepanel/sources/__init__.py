"""Readers of raw tables and writers of results."""
