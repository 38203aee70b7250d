"""Operators of the interval-event engine."""
