"""Column functions and orderings that the operators share."""
