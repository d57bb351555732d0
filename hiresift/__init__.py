"""Recruiting analytics as Spark jobs."""
