"""Batch and streaming readers of change logs, configuration, server metadata."""
