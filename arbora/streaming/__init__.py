"""Change logs, windows and other streaming jobs."""
