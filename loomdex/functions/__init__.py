"""Column functions: hashing, paths, text, vectors, requests."""
