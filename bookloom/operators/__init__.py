"""Operators of the order-book engine."""
