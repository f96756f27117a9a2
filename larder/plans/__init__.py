"""Reporting views and lookups, and reading them by name."""
