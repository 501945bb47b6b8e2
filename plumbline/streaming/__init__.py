"""Structured Streaming forms of intake, chain checks and readiness counts."""
