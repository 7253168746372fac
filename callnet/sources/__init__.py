"""Scans, sinks, schemas, and the derivation of call tables from the test tables."""
