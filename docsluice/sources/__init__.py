"""sources of docsluice."""
