"""Distributed building blocks: Arrow kernels over pixels, and merged moments."""
