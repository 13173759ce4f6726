"""Subpackage of skein."""
