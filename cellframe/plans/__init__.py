"""End results composed from the operators."""
