"""Operators over trees."""
