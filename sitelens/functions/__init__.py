"""Column functions: every value parser and statistic used by the operators."""
