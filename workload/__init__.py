"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""
