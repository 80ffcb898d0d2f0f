"""Moraine sources."""
