"""Readers, sinks, manifests and generators."""
