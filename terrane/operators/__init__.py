"""Joins, roll-ups and iterative operators built from DataFrame jobs."""
