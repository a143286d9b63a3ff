"""Whole reports and ingests, composed from the operators."""
