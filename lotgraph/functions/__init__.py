"""Column helpers: identifiers, values and statistics."""
