"""Registered queries: operators bound to tables, each with its SQL twin."""
