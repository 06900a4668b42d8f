"""Readers of logs, vectors and uploaded document parts, and writers of tables."""
