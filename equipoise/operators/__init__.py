"""Operators on signed graphs."""
