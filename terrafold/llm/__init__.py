"""Operators for building large text corpora. Nothing outside this subpackage imports it."""
