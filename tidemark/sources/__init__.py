"""Readers and writers, kept apart from the jobs."""
