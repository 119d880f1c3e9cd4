"""Structured Streaming: the columnar replica follows the commit log."""
