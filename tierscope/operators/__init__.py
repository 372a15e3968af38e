"""Analyses: every operator takes a dict of typed tables and returns a lazy DataFrame."""
