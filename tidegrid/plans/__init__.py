"""Compositions of operators: viewport queries and chart-ready tables."""
