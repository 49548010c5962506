"""Whole preparation plans, and the catalog of registered queries."""
