"""Column functions: nested arrays, position-keyed randomness, text conversion, base64, tuples."""
