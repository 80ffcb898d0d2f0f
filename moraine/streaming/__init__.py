"""Moraine streaming."""
