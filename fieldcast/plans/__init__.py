"""Bindings from the given tables to the domain, and the registered queries."""
