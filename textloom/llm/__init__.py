"""Operators for large training corpora; nothing outside this subpackage imports it."""
