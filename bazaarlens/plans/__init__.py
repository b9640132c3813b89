"""The analyses: shared datasets and one function per result set."""
