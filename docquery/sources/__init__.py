"""Reading, typing, flattening and keeping datasets."""
