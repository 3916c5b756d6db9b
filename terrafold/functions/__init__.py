"""Spatial functions: SQL registration, the Column form, and native forms over point and box structs."""

from .registry import call, register_all

__all__ = ["call", "register_all"]
