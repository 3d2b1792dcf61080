"""Column functions: text to terms, vector text format, random features."""
