"""Whole reports and programs composed from the operators."""
