"""Column-level building blocks (no actions, no Python UDFs)."""
