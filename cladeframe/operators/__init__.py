"""Relational operators and block kernels of community analysis."""
