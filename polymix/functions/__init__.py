"""Row functions."""
