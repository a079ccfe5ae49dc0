"""Column functions: text, identifiers, vectors, sets and model replies."""
