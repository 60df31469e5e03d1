"""Registered queries of the core operators."""
