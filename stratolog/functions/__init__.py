"""Sparse index, Bloom filter and statistics functions."""
