"""Whole dataflows composed from the operators, and their registered queries."""
