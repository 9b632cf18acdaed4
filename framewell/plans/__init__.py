"""Requests, plans, caches and bundles."""
