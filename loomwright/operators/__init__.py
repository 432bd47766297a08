"""Operators of the reference, as DataFrame functions."""
