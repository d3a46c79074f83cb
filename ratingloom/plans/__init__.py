"""Whole flows: recommenders, the hybrid engine, evaluation, queries."""
