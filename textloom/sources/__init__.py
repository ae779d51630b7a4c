"""Readers and writers of corpora and indexes."""
