"""Structured Streaming jobs over change events, requests and audit rows."""
