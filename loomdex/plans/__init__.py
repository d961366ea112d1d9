"""Named queries over the data folder's tables."""
