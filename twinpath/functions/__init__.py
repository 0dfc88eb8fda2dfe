"""Column functions: no I/O, no shuffle."""
