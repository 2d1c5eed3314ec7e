"""DataFrame operators: what needs more than one row."""
