"""Whole queries assembled from the operators."""
