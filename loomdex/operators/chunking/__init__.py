"""Splitting files into chunks: line windows, gaps between chunks, syntax."""
