"""Analyzers, the engine and the registered queries."""
