"""Structured Streaming jobs over metric logs."""
