"""Readers, writers, manifests and layouts."""
