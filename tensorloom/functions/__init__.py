"""Subpackage of tensorloom."""
