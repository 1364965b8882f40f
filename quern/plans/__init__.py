"""Whole jobs made of the operators, and the queries with their SQL."""
