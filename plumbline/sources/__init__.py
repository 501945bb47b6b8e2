"""Strict readers, file inventories, intake ledgers and version tables."""
