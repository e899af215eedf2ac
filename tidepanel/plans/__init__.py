"""Registered queries: each applies operators to the driver's tables and has SQL that checks it."""
