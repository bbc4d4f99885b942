"""Structured Streaming over the job event stream."""
