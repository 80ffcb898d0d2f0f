"""Moraine operators."""
