"""Composed analyses with a typed result, the registry that names them, and the registered queries."""
