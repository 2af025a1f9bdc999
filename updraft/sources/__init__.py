"""Readers for price bars, the universe and dated theme reports."""
