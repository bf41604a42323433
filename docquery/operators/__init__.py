"""Operators over matched documents."""
