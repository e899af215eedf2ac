"""Column builders: scalar, trailing per security, and across securities of a session."""
