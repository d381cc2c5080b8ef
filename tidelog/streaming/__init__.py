"""Structured Streaming: transaction context, sinks, pipes."""
