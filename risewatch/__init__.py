"""Streaming-signal analytics on Spark: rise alerts, routing, statistics and time-series points."""
