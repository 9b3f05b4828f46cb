"""Parlance: analytics over multi-party conversation logs, expressed as Spark DataFrame plans."""

from parlance.config import Settings

__all__ = ["Settings"]
