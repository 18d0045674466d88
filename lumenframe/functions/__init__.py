"""Column expressions shared by the operators."""

from lumenframe.functions.validity import any_invalid, invalid

__all__ = ["any_invalid", "invalid"]
