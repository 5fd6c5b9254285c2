"""Operators on whole tables: cleaning, joins, roll-ups, contrasts, integrals, models."""
