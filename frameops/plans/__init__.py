"""Declarative JSON plans: running one plan, and checking tables of plans."""
