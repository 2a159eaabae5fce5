"""Derived tables, the triage report and the catalogue of registered queries."""
