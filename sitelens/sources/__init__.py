"""Readers: CSV exports, JSON artefacts, seeded dimensions."""
