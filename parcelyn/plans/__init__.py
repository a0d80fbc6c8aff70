"""Whole plans over the operators: the listing adapter and the registered queries."""
