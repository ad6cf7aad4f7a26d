"""Whole analyses: engines with one call each, adapters from business tables, and the registered queries."""
