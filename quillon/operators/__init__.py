"""Relational operators: dedup, similarity, components, rules, sampling, reports."""
