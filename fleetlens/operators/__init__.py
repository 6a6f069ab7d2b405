"""Relational building blocks: windows, features, rules, graph, health, quality."""
