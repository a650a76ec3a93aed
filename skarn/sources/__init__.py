"""Readers of the tables that queries run on."""
