"""Structured Streaming operators over run events."""
