"""Investigations: the composed queries a user runs."""
