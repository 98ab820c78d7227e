"""Whole diagnostics: all operators over a set of tables, then findings, recommendations and a report."""
