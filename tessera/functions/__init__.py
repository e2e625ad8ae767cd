"""Column functions: content types, patterns, string similarities."""
