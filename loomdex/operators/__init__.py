"""Operators: chunking, Merkle trees, caches, synchronisation, vector index, models."""
