"""Sources of the interval-event engine."""
