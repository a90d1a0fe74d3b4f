"""Lodestone streaming."""
