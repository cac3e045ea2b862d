"""Operators on free text and names. Nothing else in the package imports this subpackage."""
