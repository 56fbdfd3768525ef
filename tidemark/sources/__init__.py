"""Versioned tables in shared storage, and key-value commands over them."""
