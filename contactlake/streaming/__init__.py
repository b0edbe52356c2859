"""Incremental forms of the contact and status jobs."""
