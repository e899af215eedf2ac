"""Operators on panels, bitemporal facts, factors, portfolios and accounts."""
