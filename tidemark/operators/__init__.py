"""Operators as DataFrame compositions: versions, placement, observability, cluster state, access."""
