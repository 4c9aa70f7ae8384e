"""Column helpers: geometry, vectors, text and time."""
