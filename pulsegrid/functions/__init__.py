"""functions of the analytics library."""
