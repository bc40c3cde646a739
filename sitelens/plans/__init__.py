"""Logical plans built from the operators: marts, reports, explanation, whole load."""
