"""Stateful processors for Structured Streaming."""
