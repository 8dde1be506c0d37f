"""Registered queries over the given tables, each with its SQL where SQL can say it."""
