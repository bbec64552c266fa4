"""Column expressions: identity, names, rules and text extraction."""
