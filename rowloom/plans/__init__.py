"""Lazy plans composed from operators."""
