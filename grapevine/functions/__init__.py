"""Column expressions."""

from . import labels, numbers, text

__all__ = ["labels", "numbers", "text"]
