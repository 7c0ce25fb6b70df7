"""Queries over tables that use the corpus."""
