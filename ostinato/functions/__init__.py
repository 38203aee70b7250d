"""Functions of the interval-event engine."""
