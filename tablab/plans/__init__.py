"""Composed plans: the replayable recipe and the registered query catalogue."""
