"""Retrieval analytics as DataFrame plans."""
