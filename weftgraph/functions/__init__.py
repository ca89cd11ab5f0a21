"""Expressions and helpers that operators share."""
