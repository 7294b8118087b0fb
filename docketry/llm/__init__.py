"""Operators for preparing training text: one module per operator, see README."""
