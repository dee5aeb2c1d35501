"""DataFrame-to-DataFrame operators over an entity-by-day panel."""
