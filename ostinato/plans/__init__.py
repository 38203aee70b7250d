"""Plans of the interval-event engine."""
