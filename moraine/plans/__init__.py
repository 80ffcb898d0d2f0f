"""Moraine plans."""
