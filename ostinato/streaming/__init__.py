"""Streaming of the interval-event engine."""
