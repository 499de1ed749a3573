"""Relational building blocks: rules, locations, index, candidates, scores, reports."""
