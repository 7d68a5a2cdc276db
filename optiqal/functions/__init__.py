"""Column functions and DataFrame helpers that the operators share."""
