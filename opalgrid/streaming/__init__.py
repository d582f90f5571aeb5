"""Operator trees over streams."""

from .trees import follow

__all__ = ["follow"]
