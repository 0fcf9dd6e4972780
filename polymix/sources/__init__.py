"""Readers of the domain tables."""
