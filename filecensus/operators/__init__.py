"""Relational operators over file catalogs."""
