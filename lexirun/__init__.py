"""Exact substring search and Burrows-Wheeler analytics as DataFrame operations."""
