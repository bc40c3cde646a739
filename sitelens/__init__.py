"""Compliance analytics on Spark: cleaning, issue ledger, marts, gates."""
