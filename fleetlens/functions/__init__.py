"""Column expressions (no Python UDFs): versions, text, scores."""
