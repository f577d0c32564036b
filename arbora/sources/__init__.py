"""Readers, writers and the lift of tables into triples."""
