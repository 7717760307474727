"""Markdown as events."""
