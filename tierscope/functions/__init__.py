"""Reusable column expressions and aggregation shapes."""
