"""Column builders: geometry, text and parsing."""
