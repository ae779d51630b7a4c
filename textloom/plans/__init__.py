"""Registered queries with their SQL oracles."""
