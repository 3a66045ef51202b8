"""The same work on streams of incoming results."""
