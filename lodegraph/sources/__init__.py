"""Readers: working trees, commit logs, manifests and Python modules as tables."""
