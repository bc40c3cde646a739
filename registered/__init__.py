"""The registered queries: every operator on the driver's tables, with its SQL.

``inputs`` projects whole driver tables into the raw shapes the operators read;
``ctes`` says the same, and the expected results, in DuckDB SQL.
"""
