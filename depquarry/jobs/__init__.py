"""Whole jobs and registered queries."""
