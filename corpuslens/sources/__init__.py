"""Readers that turn texts into the tables of a corpus."""
