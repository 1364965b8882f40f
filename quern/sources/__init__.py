"""Readers of feeds, landed web pages and text lists, and the mapping of star-schema tables to shops and offers."""
