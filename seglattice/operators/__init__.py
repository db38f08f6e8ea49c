"""Tokenization operators: the per-text kernel, its columns, and the lattice as DataFrames."""
