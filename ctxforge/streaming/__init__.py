"""Structured Streaming forms of the usage analytics and of keyed session state."""
