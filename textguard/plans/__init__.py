"""Whole flows from a source to its report, and the sinks they end in."""
