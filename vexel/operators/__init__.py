"""Relational vector operators: exact and approximate k nearest neighbours, training, encoding, graphs."""
