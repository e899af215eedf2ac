"""Fundamentals: filings to bitemporal versions, quarters and trailing years, derived fields."""
