"""Operators over points, nodes and sectioned results."""
