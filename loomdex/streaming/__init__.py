"""Streams of file events: dirty files, Merkle roots, periodic syncs."""
