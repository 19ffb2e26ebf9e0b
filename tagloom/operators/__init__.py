"""Operators over reads, whitelists and tagged records."""
