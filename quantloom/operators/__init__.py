"""DataFrame operators of the analytics pipeline."""
