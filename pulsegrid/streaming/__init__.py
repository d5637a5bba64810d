"""streaming of the analytics library."""
