"""Column-level functions (text, time)."""
