"""DataFrame-to-DataFrame operators over evidence tables."""
