"""Adapters from landed data to items, and item storage."""
