"""Monitoring a growing chain."""
