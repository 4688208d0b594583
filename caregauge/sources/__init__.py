"""Readers of delivered files and generated relations."""
