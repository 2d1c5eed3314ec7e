"""The same functions on streams, and windowed live counts."""
