"""Job descriptions and the jobs composed from the operators."""
