"""Structured Streaming forms of the episode, metric and label jobs."""
