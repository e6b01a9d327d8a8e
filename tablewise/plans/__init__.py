"""Composed analyses and the registered queries over the shared tables."""
