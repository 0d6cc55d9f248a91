"""operators of docsluice."""
