"""Structured Streaming forms of the operators and the realtime job."""
