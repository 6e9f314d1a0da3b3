"""Keyed state, query start-up and sinks for Structured Streaming."""
