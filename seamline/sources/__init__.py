"""Readers: catalogs, JSON, TSV, transaction logs, model source trees, commit logs."""
