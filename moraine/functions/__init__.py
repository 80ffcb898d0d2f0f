"""Moraine functions."""
