"""Whole analyses put together from the operators."""
