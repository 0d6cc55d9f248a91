"""streaming of docsluice."""
