"""Streaming bars: the polling of minute quotes as a Structured Streaming query."""
