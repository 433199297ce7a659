"""Operators on sensor logs, as DataFrame functions."""
