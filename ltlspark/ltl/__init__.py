"""Formulas of linear temporal logic in plain Python; no Spark here."""
