"""Relational and panel operators: pure functions from DataFrame to DataFrame."""
