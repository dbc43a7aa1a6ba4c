"""Compositions of the operators: the analyses a user runs."""
