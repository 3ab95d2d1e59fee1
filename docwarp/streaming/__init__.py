"""Streaming twins of the batch transitions: manifest intake, and timers for missing documents and stale jobs."""
