"""Readers, writers and the price panels derived from fact tables."""
