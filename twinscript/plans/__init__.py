"""Whole dataflows composed from the operators."""
