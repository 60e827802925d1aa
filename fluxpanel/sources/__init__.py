"""Readers, lattices, writers and the synthetic panel."""
