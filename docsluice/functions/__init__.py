"""functions of docsluice."""
