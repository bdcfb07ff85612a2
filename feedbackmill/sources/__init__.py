"""Readers that turn files, stored pages and stored tables into review rows."""
