"""Readers, writers and plug-in registries."""
