"""Loads, queries, views and report data sets."""
