"""Structured Streaming counterparts of the audit and upload queries."""
