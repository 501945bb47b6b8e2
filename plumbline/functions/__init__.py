"""Column-level functions: canonical rendering, lexical types, text helpers."""
