"""Structured Streaming jobs that share their logic with the batch operators."""
